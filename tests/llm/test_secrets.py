"""Secret scans against plain Python: the base forms, the battery and the thresholds."""

import base64
import hashlib
import math
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from meshweave.llm import queries, secrets

KEYS = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    """The forms as the contract words them: every match of the open pattern, then those that are too short dropped."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(KEYS, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def upper(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery(token):
    """e, size and p of a token, or None: the four tests and Fisher's sum by their textbook formulas."""
    t = token.rstrip("=")
    for e, classes in enumerate(secrets.ENCODINGS):
        alphabet = "".join(classes)
        if set(t) <= set(alphabet):
            break
    else:
        return None
    n, k = len(t), len(alphabet)
    if n * math.log2(k) < secrets.LEAST_BITS:
        return None
    v = np.array([alphabet.index(c) for c in t])
    counts = np.bincount(v, minlength=k)
    symbols = (counts**2).sum() * k / n - n
    p = [upper((symbols - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    if len(classes) > 1:
        x = sum((sum(c in part for c in t) - n * len(part) / k) ** 2 / (n * len(part) / k) for part in classes)
        f = len(classes) - 1
        p.append(upper(((x / f) ** (1 / 3) - 1 + 2 / (9 * f)) / math.sqrt(2 / (9 * f))))
    high = v >= k // 2
    turns = (high[1:] != high[:-1]).sum()
    p.append(math.erfc(abs(turns - (n - 1) / 2) / math.sqrt((n - 1) / 4) / math.sqrt(2)))
    c = v - (k - 1) / 2
    p.append(math.erfc(abs((c[1:] * c[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1)) / math.sqrt(2)))
    x = -sum(math.log(max(q, 1e-300)) for q in p)
    return e, int(math.log2(n)), math.exp(-x) * sum(x**j / math.factorial(j) for j in range(len(p)))


def least(found, rate=0.05, few=50):
    """Threshold of each stratum."""
    count = lambda rows: np.bincount([min(int(p * secrets.BINS), secrets.BINS - 1) for _, _, p in rows], minlength=secrets.BINS)
    out = {}
    for e, size in {x[:2] for x in found}:
        own = [x for x in found if x[:2] == (e, size)]
        c = count(own if len(own) >= few else [x for x in found if x[0] == e])
        rest = c[secrets.SURE :].sum() / (1 - secrets.SURE / secrets.BINS)
        fits = [j for j in range(secrets.SURE) if c[j:].sum() - rest * (1 - j / secrets.BINS) <= rate * c[j:].sum()]
        out[e, size] = min([*fits, secrets.SURE]) / secrets.BINS
    return out


def expected(texts):
    tokens = [[(m.start(), m.end(), battery(m[0])) for m in re.finditer(secrets.TOKEN, t or "")] for t in texts]
    limit = least([x for ts in tokens for *_, x in ts if x])
    return [sorted([*base_spans(t or ""), *((a, 3, b) for a, b, x in ts if x and x[2] >= limit[x[:2]])]) for t, ts in zip(texts, tokens, strict=True)]


def made_texts(seed=5, docs=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 22)))
    some = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    forms = [
        lambda: f'password = "{some(string.ascii_letters, rng.randrange(5, 14))}"', lambda: f"API_KEY:{some('abc=/.', 9)}", lambda: "AKIA" + some(string.ascii_uppercase + string.digits, rng.randrange(9, 18)),
        lambda: some("0123456789abcdef", rng.randrange(28, 45)), lambda: base64.b64encode(rng.randbytes(30)).decode(), lambda: some(string.digits, 24), lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26),
        lambda: "getSomeValueFromTheTable", lambda: "some_long-name_with-signs", lambda: 'token=ab token="secret=abcdefgh"', lambda: "naïve𝄞 Secret : x", lambda: some(string.ascii_letters + string.digits, 32),
    ]
    texts = [" ".join(rng.choice(forms)() if rng.random() < 0.2 else word() for _ in range(rng.randrange(0, 40))) for _ in range(docs)]
    return [*texts, None, "", "𝄞" * 40 + "token=12345678", "AKIA" * 9, "0" * 70000, " ".join(["deadbeef" * 4] * 700), some(string.ascii_letters + string.digits, 9001), texts[0]]


def test_query_against_plain_python(spark, tmp_path):
    texts = made_texts()
    rows = [(i if i < len(texts) - 1 else 0, t, 1, "x", [1]) for i, t in enumerate(texts)]
    rows.append((None, "token: abcdefghij", 1, "x", [1]))
    spark.createDataFrame(rows, "doc_id long, text string, rank int, id string, token array<int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in queries.op11_secrets(spark, str(tmp_path)).collect()]
    want = []
    for (i, *_), spans in zip(rows, expected([r[1] for r in rows]), strict=True):
        shown = lambda xs: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in xs)
        want.append((i, *[sum(k == rank for _, k, _ in spans) for rank in range(3)], hashlib.sha256(shown([x for x in spans if x[1] < 3]).encode()).hexdigest(), shown(spans)))
    key = lambda r: (str(r[0]), r[5])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum("random" in r[5] for r in got) > 20


def test_battery(spark):
    tokens = [m[0] for t in made_texts(9, 60) if t for m in re.finditer(secrets.TOKEN, t)]
    rows = spark.createDataFrame([(tokens,)], "t array<string>").select(F.transform("t", lambda t: F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"), t.alias("match"))).alias("m"))
    got = [(x["e"], x["size"], x["p"]) for x in rows.select(secrets.tested(F.col("m")).alias("x")).first()["x"]]
    want = [x for x in map(battery, tokens) if x]
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-4, atol=1e-12)


def test_false_discoveries(spark):
    """Random keys among ten times as many invented identifiers: the rate holds and most keys are found."""
    rng = random.Random(2)
    alphabet = string.ascii_letters + string.digits
    parts = ["get", "Set", "Value", "table", "Of", "index", "2", "Row", "x1", "Name", "user", "Id", "HTTP", "map", "To", "v2", "Key"]
    keys = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 40))) for _ in range(300)]
    names = ["".join(rng.choice(parts) for _ in range(7)) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*keys, *names])], "doc_id long, text string")
    out, held = secrets.scan(df)
    found = {r["id"] for r in out.collect() if any(x["rank"] == 3 for x in r["spans"])}
    held.drop()
    right = len([i for i in found if i < 300])
    assert right >= 150 and len(found) - right <= 0.1 * len(found), (right, len(found))


def test_empty(spark):
    out, held = secrets.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []
    held.drop()
