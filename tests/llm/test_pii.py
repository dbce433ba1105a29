import hashlib
import re

import numpy as np
import pytest

from gridloom.llm import pii
from gridloom.llm.pii import KINDS, TAGS, WINDOW, Tagger, all_spans, base_spans, fitted, learned_spans, plausible, reconciled, rewritten, tags_of, windows_of

SF = "/root/testdata/sf0.1"


def card(k):
    head = f"4{k:014d}"
    return next(head + str(d) for d in range(10) if pii.luhn(head + str(d)))


def made(n=150):
    rng, words = np.random.default_rng(1), "the cat sat under password=1f0e3dad99908345f7 version 2.0 of a table and was dot at home, isn't it? 42 times in 2019-10-11".split()
    out = []
    for i in range(n):
        text = lambda: " ".join(rng.choice(words, 5))
        name = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3 + i % 5))
        for kind, span in (("email", (f"{name}.{i:02d}@mail{i % 9}.example.com", f"{name}{i}.x@host{i % 9}.example.org", f"{name}@{name[::-1]}.net")[i % 3]), ("ip", f"{i % 250}.{i * 7 % 256}.10.{i % 99}"), ("card", card(i * 7919)), ("phone", f"+1 ({200 + i}) 555-{1000 + i}")):
            a = text() + " "
            out.append((kind, a + span + " " + text(), [(kind, len(a), len(a) + len(span))]))
        out += [("", (text() + " " + text())[:96], [])] * 2
    return out


@pytest.fixture(scope="module")
def model():
    return fitted(made())


def plain(text):
    """The rules, as they are written down."""
    out = []
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for kind, rule in rules:
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_rules_against_their_patterns():
    rng = np.random.default_rng(7)
    for size in (3, 8, 30, 60) * 500:
        text = "".join(rng.choice(list("a1@.-+ 9_é(%")) for _ in range(size))
        assert base_spans(text) == plain(text), text
    texts = ["a@b.c@d.e", "x@y.z_q@f.gh", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.001", "1.2.3.4" * 5, "+1 (588) 555-1833", "++123456789", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", card(5) + " " + card(6)]
    for text in texts:
        assert base_spans(text) == plain(text), text
    assert luhn_numbers() == ["4111111111111111", "5500005555555559"]


def luhn_numbers():
    return [n for n in ("4111111111111111", "4111111111111112", "5500005555555559", "5500005555555555") if pii.luhn(n)]


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1 ", "1.", "a.", "@", "a@", "+1", "+1 (", "a@b-"):
        base_spans(piece * 300_000)


def test_gradients():
    net, rng = Tagger(), np.random.default_rng(0)
    codes = rng.integers(1, 60, (3, 12)).astype(np.uint8)
    tags = np.stack([tags_of(12, [("ip", 2, 7)]), tags_of(12, [("email", 0, 3), ("phone", 5, 12)]), tags_of(12, [])])
    _, g = net.gradients(codes, tags)
    for k, x in g.items():
        for at in [np.unravel_index(np.abs(x).argmax(), x.shape)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-5
            up = net.gradients(codes, tags)[0]
            net.p[k][at] = old - 1e-5
            down = net.gradients(codes, tags)[0]
            net.p[k][at] = old
            assert abs((up - down) / 2e-5 - x[at]) < 1e-5 + 1e-4 * abs(x[at]), k


def test_decoder_against_plain_passes_and_all_paths():
    net = Tagger(seed=3)
    rng = np.random.default_rng(2)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape)
    codes = rng.integers(1, 60, (40, 4)).astype(np.uint8)
    e = net.emissions(codes)
    model = net.folded()
    assert np.allclose(e - e[:, :, :1], model.scores(codes).transpose(0, 2, 1), atol=1e-4)
    found = {}
    for w, kind, s, t, margin in model.spans(codes):
        found.setdefault(w, []).append((kind, s, t, margin))
    import itertools

    paths = [p for p in itertools.product(range(TAGS), repeat=4) if all(pii.ALLOWED[a, b] for a, b in zip(p, p[1:]))]
    for w in range(40):
        score = lambda p: net.p["s"][p[0]] + sum(e[t, w, k] for t, k in enumerate(p)) + sum(net.p["a"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(paths, key=score)
        want = []
        for t, k in enumerate(best):
            kind = KINDS[(k - 1) // 2] if k else None
            if kind and (t == 0 or not best[t - 1]):
                want.append([kind, t, t + 1])
            elif kind:
                want[-1][2] = t + 1
        assert [list(x[:3]) for x in found.get(w, [])] == want
        if len(want) == 1 and want[0][1] > 0:
            assert abs(score(best) - score((0, 0, 0, 0)) - found[w][0][3]) < 1e-3


def test_windows_cover_texts_and_spans_are_reconciled():
    for n in (1, WINDOW, WINDOW + 1, 5 * WINDOW + 17):
        starts = windows_of(n)
        seen = np.zeros(n, bool)
        for s in starts:
            seen[s : s + WINDOW] = True
        assert seen.all() and starts[-1] + min(n, WINDOW) == n
    got = reconciled([("card", 90, 100, 6.0, True), ("card", 95, 112, 8.0, False), ("phone", 98, 120, 7.0, False), ("ip", 0, 5, 1.0, False)])
    assert [x[:3] for x in got] == [("ip", 0, 5), ("card", 90, 112)]
    assert [x[:3] for x in reconciled([("ip", 0, 5, 2.0, False), ("card", 4, 9, 3.0, False), ("ip", 8, 12, 2.0, False)])] == [("ip", 0, 5), ("ip", 8, 12)]
    assert all_spans([("ip", 5, 9)], [("email", 8, 12, 9.0), ("email", 9, 12, 9.0)]) == [("email", 9, 12), ("ip", 5, 9)]


def test_held_out_rewritten_spans_are_found_and_clean_text_is_left_alone(model):
    rng, right, false, total = np.random.default_rng(9), 0, 0, 0
    for i in range(1000, 1060):
        for kind, span in (("email", f"bob{i}.x@host{i % 7}.example.com"), ("ip", f"{i % 250}.{i * 3 % 256}.77.{i % 99}"), ("card", card(i * 104729)), ("phone", f"+1 ({i - 700}) 555-{i}")):
            other = rewritten(kind, span, rng)
            text = "the cat was under a table at home " * (i % 20) + other + " of a table and it sat"
            start = text.index(other)
            got = learned_spans([text], model)[0]
            total += 1
            right += (kind, start, start + len(other)) in [g[:3] for g in got]
            false += sum(g[2] <= start or g[1] >= start + len(other) for g in got)
    assert right > 0.85 * total and false <= 2
    clean = ["the cat sat under password=1f0e3dad99908345f7 version 2.0 of a table dot at home " * 30, "x" * 3000, "42 times in 2019-10-11 " * 50]
    assert learned_spans(clean, model) == [[], [], []]


def test_plausible():
    assert plausible("email", "a (at) b dot org") and plausible("email", "a @ b.org") and not plausible("email", "Mentpa Mentpa") and not plausible("email", "at b.org")
    assert plausible("ip", "1[.]2[.]3[.]255") and not plausible("ip", "1.2.3.256") and not plausible("phone", "531ccd051a92ebcb68") and plausible("phone", "(588) 555-1833 1".strip())
    assert plausible("card", "4111.1111.1111.1111") and not plausible("card", "4111.1111.1111.1112")


def test_sample_is_bounded_and_model_found_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = pii.train(docs, steps=300)
    got = pii.personal_data(docs, model).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    hits = 0
    for r in got:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in KINDS]
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added and spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
        hits += r.n_added
    assert len(got) == len(texts) and hits <= 0.002 * len(got)


def test_odd_rows(spark, model):
    long = "word and " * 60_000 + "ann (at) mail (dot) example (dot) com" + " and word" * 5
    rows = [(1, None), (1, None), (2, ""), (None, "mail ann@example.com now"), (3, long), (4, "é" * 300 + " 10.0.0.1 é"), (5, "a\x00b퟿ 10.0.0.1")]
    docs = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], "doc_id long, text string, n_email int, `a.b` string, row string")
    out = pii.personal_data(docs, model)
    assert out.columns == ["doc_id", "text", "a.b", "row", *pii.ADDED]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[1, None].spans == got[2, ""].spans == "" and got[None, rows[3][1]].spans == "email:5:20"
    start = long.index("ann (")
    kind, s, e = got[3, long].spans.split(":")
    assert kind == "email" and start <= int(s) < start + 8 and int(e) == start + 37 and got[3, long].n_added == 1
    assert got[4, rows[5][1]].spans == "ip:301:309"
    assert out.count() == 7 and pii.personal_data(docs.limit(0), model).count() == 0
    assert pii.train(docs.limit(0)) is None and pii.train(docs.where("doc_id = 2")) is None
    assert {r.n_added for r in pii.personal_data(docs, None).collect()} == {0}
