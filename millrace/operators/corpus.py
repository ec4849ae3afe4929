"""A seeded synthetic corpus with planted defects and labels, for tests and demonstrations.

Everything derives from hashes of the row number and the seed, so rows are
generated in parallel and the corpus of a seed is always the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from millrace.config import CorpusConfig

_NOUNS = "harbour garden ledger engine valley orchard signal bridge market lantern archive river".split()
_VERBS = "opened measured repaired counted crossed painted followed rebuilt praised closed".split()
_PLACES = "Ashmere Brindle Corfield Dunwold Eastry Farrow Gildon Harnham".split()
_SCHEMA = "id string, text string, source string, timestamp string, gt_kind string, gt_dup_of string"


def _body(rng: np.random.Generator, source: str) -> str:
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    lines = []
    for _ in range(int(rng.integers(4, 10))):
        n = int(rng.integers(2, 9000))
        if source == "code":
            lines.append(f"def {pick(_VERBS)}_{pick(_NOUNS)}_{n}(x): return x + {int(rng.integers(99999))}")
        elif source == "recipes":
            lines.append(f"Take {n} grams of {pick(_NOUNS)} flour and stir it for {int(rng.integers(2, 90))} minutes in {pick(_PLACES)}.")
        elif source == "forum_qa":
            lines.append(f"Has anyone {pick(_VERBS)} a {pick(_NOUNS)} number {n} near {pick(_PLACES)} before?")
        else:
            lines.append(f"Crews {pick(_VERBS)} the {pick(_NOUNS)} and the {pick(_NOUNS)} of {pick(_PLACES)} for {n} crowns.")
    return ("\n" if source == "code" else " ").join(lines)


def _edited(rng: np.random.Generator, text: str) -> str:
    words = text.split()
    for _ in range(max(1, int(len(words) * rng.uniform(0.08, 0.15)))):
        at, what = int(rng.integers(len(words))), int(rng.integers(3))
        if what == 0 and len(words) > 5:
            del words[at]
        elif what == 1:
            words.insert(at, _NOUNS[int(rng.integers(len(_NOUNS)))])
        else:
            words[at] = _NOUNS[int(rng.integers(len(_NOUNS)))]
    out = " ".join(words)
    return out if out != text else text + " (edited)"


_JUNK = ("junk_empty", "junk_short", "junk_boilerplate", "junk_mojibake")


def _junk(kind: str, i: int) -> str:
    return {"junk_empty": "  ", "junk_short": "ok then", "junk_boilerplate": f"Accept cookies. Privacy policy. Click here number {i} to go on reading.", "junk_mojibake": f"The cafÃ© number {i} served a crÃªpe to all of us today."}[kind]


def corpus_hash(df: DataFrame) -> str:
    """Identity of a corpus by its rows in the order of their ids."""
    from millrace.sources.ingest import batch_hash

    return batch_hash(df, order=["id", *[c for c in df.columns if c != "id"]])


def generate(spark: SparkSession, cfg: CorpusConfig | None = None) -> DataFrame:
    """Corpus records with labels: clean, exact_dup, near_dup, junk_*, pii."""
    cfg = cfg or CorpusConfig()
    n = cfg.n_docs
    counts = [round(n * r) for r in (cfg.exact_dup_rate, cfg.near_dup_rate, cfg.junk_rate, cfg.pii_rate)]
    clean = n - sum(counts)
    names = [s for s, _ in cfg.source_weights]
    weights = np.array([w for _, w in cfg.source_weights])
    step = cfg.span_days * 86_400 / (n + 1)

    def original(i: int) -> tuple[str, str]:
        rng = np.random.default_rng([cfg.seed, 1, i])
        source = names[int(rng.choice(len(names), p=weights / weights.sum()))]
        return source, _body(rng, source)

    def row(k: int) -> tuple:
        rng = np.random.default_rng([cfg.seed, 2, k])
        at = k if k < clean else int(rng.integers(clean))
        source, text = original(at)
        kind, of = "clean", None
        if k >= clean:
            bounds = np.cumsum(counts) + clean
            if k < bounds[0]:
                kind, of = "exact_dup", at
            elif k < bounds[1]:
                kind, of, text = "near_dup", at, _edited(rng, text)
            elif k < bounds[2]:
                kind = _JUNK[(k - int(bounds[1])) % len(_JUNK)]
                text = _junk(kind, k)
            else:
                kind, text = "pii", f"{original(k + n)[1]} Write to person{k}@mail.example or (555) 01{k % 100:02d}."
        moment = pd.Timestamp("2026-01-01", tz="UTC") + pd.Timedelta(seconds=min(cfg.span_days * 86_400 - 1, step * (at if of is None else at + 0.5) + (60 if of is not None else 0)))
        return f"rec-{k:06d}", text, source, moment.isoformat(), kind, None if of is None else f"rec-{of:06d}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([row(int(k)) for k in b["id"]], columns=["id", "text", "source", "timestamp", "gt_kind", "gt_dup_of"])

    return spark.range(n).mapInPandas(run, _SCHEMA)
