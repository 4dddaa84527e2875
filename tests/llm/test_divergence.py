"""The divergence audit against plain counting: small tiles and shards, odd rows, split texts, flushed counters."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, tile int"


def by_hand(rows, least, k):
    """All rows of the report from ``(text, lang, source)``."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        p = {s: {t: share(counts[lang, s][t], totals[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(totals.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    words = ["Aa", "bé", "日本", "c", "dd", "É", "é", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        some = [rng.choice(words[: 5 + s % 20]) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice([" ", "1", "\n", "_", "[", "\x7f"]).join(some), rng.choice(["en", "en", "de", None]), f"s{s}" if s else None))
    return rows


@pytest.mark.parametrize("tile,shard,k", [(256, 2048, 50), (3, 4, 2), (1, 1, 1)])
def test_by_hand(spark, tile, shard, k):
    rows = [*corpus(300, 9), *[("lonely words here", "xx", "only")] * 2, ("", "yy", "a"), (None, "yy", "b"), (None, None, None)]
    audit = divergence.count_terms(spark.createDataFrame([(1, *r, "x", 1) for r in rows], SCHEMA).repartition(3), 10)
    got = [(r["lang"], r["source"], "pair", r["item"], r["value"]) for r in divergence.distances(audit, tile, shard).collect()]
    got += [(r["lang"], r["source"], "term", r["item"], r["value"], r["rank"]) for r in divergence.excess_terms(audit, k).collect()]
    want = by_hand(rows, 10, k)
    assert sorted(r for r in got if r[2] == "term") == [r for r in want if r[2] == "term"]
    assert sorted(r for r in got if r[2] == "pair") == sorted(r[:5] for r in want if r[2] == "pair")


def test_report_with_default_limits(spark):
    rows = corpus(700, 4, seed=3)
    got = divergence.audit_report(spark.createDataFrame([(1, *r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 30, 50)
    assert divergence.audit_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_split_texts_and_flushed_counters(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é1 \n") for _ in range(rng.randrange(400))) + "q" * 100 for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array(["s", "t"] * 10), pa.array(texts)], ["lang", "source", "text"])

    def whole():
        n, docs = Counter(), Counter()
        for b in divergence._count(iter([batch])):
            for r in b.to_pylist():
                n[r["source"], r["term"]] += r["n"]
                docs[r["source"], r["term"]] += r["docs"]
        return n, docs

    once = whole()
    monkeypatch.setattr(divergence, "SLICE", 16)
    monkeypatch.setattr(divergence, "TERMS_HELD", 5)
    assert whole() == once
    terms = [set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for t in texts]
    assert once[1] == Counter((s, t) for i, own in enumerate(terms) for s in ["st"[i % 2]] for t in own)


def test_probabilities_are_exact_beyond_long_products(spark):
    got = spark.range(1).select(divergence.probability(F.lit(10**15), F.lit(10**15 + 1), F.lit(1)).alias("p"), divergence.probability(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert got["p"] == 1 + 10**9 * (10**15 + 5) // (10**15 + 6) and got["z"] == 1 + 5 * 10**9


def test_no_bucket_with_a_better_term_stays_closed(spark):
    """Many terms of equal excess at the k-th place: ties by term win, whatever bucket they are in."""
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)), "en", s) for s in ("a", "b") for _ in range(5)]
    rows += [("zz " * 3 + "ta", "en", "a")] * 8
    audit = divergence.count_terms(spark.createDataFrame([(1, *r, "x", 1) for r in rows], SCHEMA), 2)
    got = sorted((r["lang"], r["source"], "term", r["item"], r["value"], r["rank"]) for r in divergence.excess_terms(audit, 7).collect())
    assert got == [r for r in by_hand(rows, 2, 7) if r[2] == "term"]
