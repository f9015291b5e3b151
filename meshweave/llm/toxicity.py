"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms and word stems that labelled toxic texts have and clean ones have not are learnt from a bounded sample and
kept in a trie. A word of a text matches by itself, by its stem, or by one edit (insertion, deletion, substitution
or swap of neighbours): the Levenshtein automaton of the word is run down the trie, branch by branch, and leaves a
branch as soon as its state is dead. Each occurrence counts less if its context window shows a quotation. A logistic
layer turns a document's sum into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‹›"
#: Words that report what somebody said, in the corpus' languages.
REPORT = frozenset("said says quote quoted quotes wrote called word term sagte zitat schrieb wort dijo cita escribió palabra dit citation écrit mot".split())


@dataclass(frozen=True)
class Settings:
    """toxic, clean: bounds of the training sample, in the order of a hash of the id; lexicon: most terms kept; stems: their lengths.

    support, support_share: least gain of a term when the lexicon is chosen, in toxic documents, as a number and as a
    share; breadth: a stem must have so
    many times the documents of its commonest word, else the word itself is the term; odds: least log-odds; fuzzy_length and fuzzy_share: a term is matched
    with an edit if it is that long and in that share of the toxic sample; quoted: what an occurrence in a quotation counts.
    """

    toxic: int = 3000
    clean: int = 6000
    lexicon: int = 4000
    stems: tuple[int, ...] = (4, 5, 6)
    support: int = 4
    support_share: float = 0.005
    breadth: float = 1.5
    odds: float = 3.0
    fuzzy_length: int = 5
    fuzzy_share: float = 0.01
    quoted: float = 0.4
    fuzzy: float = 0.8
    window: int = 6
    seed: int = 11


def trie(terms) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = term
    return root


def within_one(word: str, root: dict) -> str | None:
    """The first term, by distance and then alphabet, within one edit or swap of the word: automaton states are rows of distances over the word, cut at 1."""
    best: tuple[int, str] | None = None
    stack = [(root, "", [*range(len(word) + 1)], None)]
    while stack:
        node, last, row, before = stack.pop()
        if "" in node and row[-1] <= 1 and (best is None or (row[-1], node[""]) < best):
            best = (row[-1], node[""])
        for ch, child in node.items():
            if ch == "":
                continue
            new = [row[0] + 1]
            for n, own in enumerate(word):
                cost = min(new[n] + 1, row[n + 1] + 1, row[n] + (own != ch))
                if before is not None and n and own == last and word[n - 1] == ch:
                    cost = min(cost, before[n - 1] + 1)
                new.append(cost)
            if min(new) <= 1 or (min(row) <= 1 and ch in word):  # a swap may pass through one dead row
                stack.append((child, ch, new, row))
    return None if best is None else best[1]


@dataclass
class Lexicon:
    """exact and stem weights, the terms matched with an edit, and surfaces that the sample cleared."""

    exact: dict[str, float]
    stems: dict[str, float]
    fuzzy: list[str]
    cleared: set[str]
    settings: Settings
    layer: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    found: dict[str, tuple[float, bool]] = field(default_factory=dict, repr=False)
    seen: set[str] = field(default_factory=set, repr=False)

    def __post_init__(self):
        self.root = trie(self.fuzzy)
        self.heads, self.tails = {t[:2] for t in self.fuzzy}, {t[-2:] for t in self.fuzzy}
        self.least, self.most = min(map(len, self.fuzzy), default=99) - 1, max(map(len, self.fuzzy), default=0) + 1

    def match(self, word: str) -> tuple[float, bool] | None:
        """Weight of a word, and whether an edit was needed."""
        if word in self.exact:
            return self.exact[word], False
        for n in self.settings.stems:
            if word[:n] in self.stems and len(word) >= n:
                return self.stems[word[:n]], False
        # an edit touches two neighbours at most, so two letters at one end are whole
        if self.least <= len(word) <= self.most and (word[:2] in self.heads or word[-2:] in self.tails) and word not in self.cleared:
            term = within_one(word, self.root)
            if term is not None:
                return self.exact.get(term, 1.0) * self.settings.fuzzy, True
        return None

    def hits(self, text: str) -> list[tuple[str, float, bool, bool]]:
        """word, weight, edited, quoted for every occurrence in the whole text."""
        low = text.lower()
        words = set(WORD.findall(low))
        for w in words - self.seen:
            m = self.match(w)
            if m is not None:
                self.found[w] = m
        if len(self.seen) > 1_000_000:
            self.seen = set()
        self.seen |= words
        if len(self.found) > 100_000:
            self.found = {w: m for w, m in self.found.items() if w in words}
            self.seen = set(words)
        here = words & self.found.keys()
        if not here:
            return []
        out, n = [], self.settings.window
        spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
        for k, (_, _, w) in enumerate(spans):
            if w in here:
                first, last = spans[max(0, k - n)], spans[min(len(spans) - 1, k + n)]
                before, after = low[first[0] : spans[k][0]], low[spans[k][1] : last[1]]
                marks = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
                said = any(x[2] in REPORT for x in spans[max(0, k - n) : k])
                out.append((w, *self.found[w], marks or said))
        return out

    def total(self, hits: list[tuple[str, float, bool, bool]]) -> float:
        return sum(weight * (self.settings.quoted if quoted else 1.0) for _, weight, _, quoted in hits)

    def score(self, text: str | None) -> float:
        total = self.total(self.hits(text)) if text else 0.0
        z = self.layer[0] + self.layer[1] * (total > 0) + self.layer[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(totals: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Weights (bias, any hit, log of the sum) by gradient descent; those of hits are held at 0 or more, for more hits are never cleaner."""
    x = np.stack([np.ones(len(totals)), (totals > 0) * 1.0, np.log1p(totals)], axis=1)
    w = np.zeros(3)
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 1.0 * (x.T @ (p - labels) / max(1, len(labels)) + 1e-4 * w * [0, 1, 1])
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, s: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn from at most toxic + clean labelled rows outside the held-out fold; ids with two different labels are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.where(F.col("label") == F.col("other")).where(~held_out).select(id_col, "label")
    order = [F.xxhash64(F.col(id_col), F.lit(s.seed)), F.col(id_col)]
    sample = known.where("label = 1").orderBy(*order).limit(s.toxic).union(known.where("label = 0").orderBy(*order).limit(s.clean))
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), id_col).select("label", "text").persist()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())
        for pdf in parts:
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                words = {w for w in WORD.findall(text.lower()) if not w.isdigit()}
                counts[label].update(words)
                counts[label].update({f"{w[:n]}*" for w in words for n in s.stems if len(w) >= n})
                counts[label][""] += 1
        terms = list(counts[0].keys() | counts[1].keys())
        if terms:
            yield pd.DataFrame({"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]})

    terms = texts.mapInPandas(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    size = terms.where("term = ''").first()
    n_clean, n_toxic = (size["clean"], size["toxic"]) if size else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    kept = terms.where("term <> ''").withColumn("odds", odds).where((F.col("odds") >= s.odds) & (F.col("toxic") >= s.support) & (F.col("toxic") >= 10 * F.col("clean")))
    rows = kept.orderBy(F.desc("toxic"), "term").limit(s.lexicon).collect()
    count_of = {r["term"]: r["toxic"] for r in rows}
    odds_of = {r["term"]: float(r["odds"]) for r in rows}
    commonest: dict[str, int] = {}
    for term, n in count_of.items():
        if not term.endswith("*"):
            for k in s.stems:
                commonest[term[:k]] = max(commonest.get(term[:k], 0), n)
    stems = {t[:-1]: odds_of[t] for t in count_of if t.endswith("*") and count_of[t] >= s.breadth * commonest.get(t[:-1], 0)}
    words = {t for t in count_of if not t.endswith("*") and not any(t[:k] in stems for k in s.stems)}

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["text"]:
                own = set(WORD.findall(text.lower()))
                rows.append(sorted(own & words) + sorted({f"{w[:k]}*" for w in own for k in s.stems if w[:k] in stems and len(w) >= k}))
            yield pd.DataFrame({"terms": rows})

    # Copies of a toxic document share many odd words; a term is kept only for what the terms before it leave to explain.
    where: dict[str, list[int]] = {}
    for n, row in enumerate(texts.where("label = 1").mapInPandas(members, "terms array<string>").toPandas()["terms"]):
        for term in row:
            where.setdefault(term, []).append(n)
    cover, least, chosen = Counter(), max(s.support, s.support_share * n_toxic), []
    while where:
        gain, term = max((sum(1 / (1 + cover[n]) ** 2 for n in at), term) for term, at in where.items())
        if gain < least:
            break
        chosen.append(term)
        cover.update(where.pop(term))
        where = {t: at for t, at in where.items() if len(at) >= least}
    stems = {t[:-1]: odds_of[t] for t in chosen if t.endswith("*")}
    exact = {t: odds_of[t] for t in chosen if not t.endswith("*")}
    fuzzy = sorted(t for t in exact if len(t) >= s.fuzzy_length and count_of[t] >= s.fuzzy_share * max(1, n_toxic))
    model = Lexicon(exact, stems, fuzzy, set(), s)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            hits = [model.hits(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "total": [model.total([h for h in x if not h[2]]) for x in hits], "edited": [sorted({h[0] for h in x if h[2]}) for x in hits]})

    seen = texts.mapInPandas(measure, "label int, total double, edited array<string>").toPandas()  # a row for each of the sample
    model.cleared = {w for label, words in zip(seen["label"], seen["edited"], strict=True) if label == 0 for w in words}
    model.found, model.seen = {}, set()
    terms.unpersist()
    texts.unpersist()
    if seen["label"].nunique() == 2:
        model.layer = logistic(seen["total"].to_numpy(), seen["label"].to_numpy())
    return model


def detect(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Every row with held_out, score (0 to 1), predicted, and spans of evidence (word, weight, edited, quoted) added.

    Labels are learnt only from rows whose crc32(id as text) mod folds is not held. Other columns pass through and are
    no input; ones named held_out, score, evidence or predicted are replaced. Null and empty texts get the score of a text without a hit; a null id is not held out; repeated rows get
    equal scores; an empty table stays empty; without usable labels the lexicon is empty and every score is low.
    """
    from .quality import fold

    out = fold(id_col, folds) == held
    model = fit(docs, labels, out, s, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon

    @F.pandas_udf("score double, evidence array<struct<word:string,weight:double,edited:boolean,quoted:boolean>>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = shared.value
        for texts in parts:
            rows = []
            for t in texts:
                hits = lexicon.hits(t) if t else []
                total = lexicon.total(hits)
                z = lexicon.layer[0] + lexicon.layer[1] * (total > 0) + lexicon.layer[2] * math.log1p(total)
                rows.append((1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), [{"word": w, "weight": g, "edited": e, "quoted": q} for w, g, e, q in hits]))
            yield pd.DataFrame(rows, columns=["score", "evidence"])

    name = unused("judged", docs)
    both = docs.withColumn("held_out", F.coalesce(out, F.lit(False))).withColumn(name, judged(F.col(text_col).cast("string")))
    return both.withColumn("score", F.col(name)["score"]).withColumn("evidence", F.col(name)["evidence"]).drop(name).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
