"""Large-scale-structure computation on Spark: meshes, spectra and particles as DataFrames."""
