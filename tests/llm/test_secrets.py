"""Whole span lists and verdicts of the secret scan against plain loops."""

import random
import re
from collections import defaultdict

from gristmill.llm import secrets

from .test_exact import brute_spans

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BARE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")


def found(text):
    """``start, kind, end, value`` of base spans and of bare tokens with a small and a capital letter and a digit."""
    out = [(a, k, b, ASSIGN.fullmatch(text[a:b])[1] if k == 0 else text[a:b]) for a, k, b in brute_spans(text)]
    for m in BARE.finditer(text):
        if all(any(f(c) for c in m[0]) for f in (str.islower, str.isupper, str.isdigit)):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def test_spans_and_verdicts(spark):
    rnd = random.Random(12)
    letters = "abcdefghjkmnpqrstuvwxyzABCDEFGH0123456789_-"
    token = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    pool = [token(rnd.randrange(18, 40)) for _ in range(30)]
    rows = []
    for i in range(240):
        parts = []
        for _ in range(rnd.randrange(0, 4)):
            value = rnd.choice(pool) if rnd.random() < 0.5 else token(rnd.randrange(6, 30))
            parts += [rnd.choice(["", "token = ", "API_KEY:'", "é ", "AKIA"]) + value, rnd.choice([" ", "\n", ", ", "' "])]
        rows.append((i, "".join(parts) if i % 9 else None, f"l{rnd.randrange(14)}", f"s{rnd.randrange(5)}" if i % 7 else None))
    hits, owners, repos = {}, defaultdict(set), defaultdict(set)
    for i, t, lang, source in rows:
        hits[i] = found(t or "")
        for *_, value in hits[i]:
            owners[value].add(source or "")
            repos[value].add("/".join(x for x in (source, lang) if x is not None))

    def verdict(v):
        if len(owners[v]) >= 3 or len(repos[v]) >= 12:
            return "copied"
        return "live" if len(owners[v]) == 1 and len(repos[v]) <= 3 else "shared"

    got = {r["doc_id"]: r for r in secrets.scan_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, own in hits.items():
        base = [s for s in own if s[1] < 3]
        bare = [s for s in own if s[1] == 3 and verdict(s[3]) == "live" and all(b[2] <= s[0] or s[2] <= b[0] for b in base)]
        spans = sorted(base + bare)
        assert got[i]["spans"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)
        assert [got[i][f"n_{k}"] for k in secrets.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert [got[i]["n_live"], got[i]["n_copied"]] == [sum(verdict(s[3]) == v for s in spans) for v in ("live", "copied")]
        assert got[i]["owners"] == max((len(owners[s[3]]) for s in own), default=0) and got[i]["repos"] == max((len(repos[s[3]]) for s in own), default=0)
        seen |= {verdict(s[3]) for s in own if s[1] == 3} | {len(bare) > 0}
    assert seen == {"live", "copied", "shared", True, False}
