import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence as d

ROWS = [("The cat sat on the mat. " * (i % 5) + f"word{i % 7} Été {'über ' * (i % 3)}", "en" if i % 3 else "de", f"s{i % 6}") for i in range(60)]
ROWS += [(None, "en", "s1"), ("", None, None), ("cat dog", None, None), ("cat", None, None), ("cat\x00dog[cat]", "", ""), ("alone", "fr", "s9"), (None, "fr", None), ("éé " * 3 + "ÉÉ", "en", "s2"), ("x" * 50_000 + " cat", "en", "s0")]
ROWS += [("y" * 400 + " cat", "de", f"s{i}") for i in range(3)] + [("CAT" * 5, "en", "zz")] * 4


def plain(rows):
    docs = [((t or ""), (g or ""), (s or "")) for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in docs}:
        seen, per = Counter(), defaultdict(Counter)
        for t, g, s in docs:
            if g == lang:
                found = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
                seen.update(set(found))
                per[s].update(found)
        kept = [t for t, n in seen.items() if n >= 3]
        total = Counter()
        for c in per.values():
            total.update({t: c[t] for t in kept})
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for s, c in per.items()}
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        far = lambda a, b: (a - b) ** 2 // b
        for s in per:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in per if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if per[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:200], 1)}
    return out


@pytest.mark.parametrize("bounds", [{}, {"AUTOMATON": 40, "LONGEST": 4, "ENTRIES": 5, "BLOCK": 2, "PIECE": 16}, {"ENTRY_BYTES": 100, "BLOCK": 3}])
def test_against_the_definition(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(d, k, v)
    docs = spark.createDataFrame([(i, *r, 7, 8) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, term int, `a.b` int").repartition(5)
    got = d.divergence(docs).collect()
    assert {tuple(r) for r in got} == plain(ROWS) and len(got) == len(plain(ROWS))


def test_pieces_part_between_terms(monkeypatch):
    text = ("Aé b-" * 50 + "c" * 40 + " d").encode()
    whole = [t for piece in d.delimited(text) for t in piece.split()]
    monkeypatch.setattr(d, "PIECE", 3)
    pieces = list(d.delimited(text))
    assert len(pieces) > 50 and all(p[:1] == p[-1:] == b" " for p in pieces)
    assert [t for p in pieces for t in p.split()] == whole and list(d.delimited(None)) == [b"  "]


def test_empty_table(spark):
    assert d.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_terms_travel_as_numbers_in_order_of_their_bytes(spark):
    rows = [("b é z a", "en", "s0"), ("a B é b", "en", "s1"), ("é a b", "en", "s0"), ("a b", "de", "s1")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    named = docs.select("lang", "source").distinct().orderBy("lang", "source").collect()
    grp = {(lang, source): k for k, (lang, source) in enumerate(named)}
    kept = d.vocabulary(docs)
    terms = [(r.lang, r.term) for r in sorted(kept.collect(), key=lambda r: r.id)]
    assert terms == [("de", "a"), ("de", "b"), ("en", "a"), ("en", "b"), ("en", "z"), ("en", "é")]
    found = d.postings(docs, kept, spark.createDataFrame([(*k, n) for k, n in grp.items()], "lang string, source string, grp long"))
    assert {t for _, t in found.dtypes} == {"bigint"}
    place = {r.id: (r.lang, r.term) for r in kept.collect()}
    got = {(*place[r.id], r.grp): (r.n, r.in_lang) for r in found.collect()}
    assert got[("en", "b", grp["en", "s1"])] == (6, 12) and got[("en", "é", grp["en", "s0"])] == (6, 9) and got[("de", "a", grp["de", "s1"])] == (3, 3) and len(got) == 9


def test_documents_are_read_as_often_for_any_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS[:12], "text string, lang string, source string")
    kind, calls = type(docs), []
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: calls.append(self.columns) or whole(self, *a, **b))
    for bound in (1 << 23, 40):
        monkeypatch.setattr(d, "AUTOMATON", bound)
        calls.clear()
        d.divergence(docs)
        assert sum("text" in columns for columns in calls) == 2


def test_terms_with_more_bytes_than_code_points(spark):
    rows = [("ß" * 200 + " " + "ß" * 257 + " " + "q" * 300 + " 🙂字 " * 3, "de", f"s{i % 2}") for i in range(4)] + [("字 ß 🙂字", "de", "s0"), ("[]{}^`@", "de", "s2")]
    got = d.divergence(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len(plain(rows))
    places = d._Known([b"a", "ß".encode() * 200, "ß".encode() * 257], 5).places(" ".join(["b", "ß" * 257, "ß" * 200, "q" * 300, "a"]).encode())
    assert places.tolist() == [-1, 7, 6, -1, 5]
