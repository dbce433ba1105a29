import numpy as np

from gridloom.llm.language_id import FILTERS, SAMPLE_DOCS, SAMPLE_WINDOWS, WIDTHS, WINDOW, Network, predict, train, windows_of

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from gridloom.llm.language_id import op8_language_id

    got = op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_folded_tables_give_the_networks_sums():
    net = Network(["a", "b", "c"])
    codes, _, _ = windows_of(["Größe und Maß 12, été".encode() * 20])
    y = np.zeros(len(codes), int)
    before = net.folded().probabilities(codes)
    eps, loss = 1e-2, lambda: -np.log(net.folded().probabilities(codes)[:, 0]).mean()
    g = net.gradients(codes, y, np.ones(len(y)))
    for k in ("v", "w3", "e"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += eps
        up = loss()
        net.p[k][at] -= 2 * eps
        down = loss()
        net.p[k][at] += eps
        assert abs((up - down) / (2 * eps) - g[k][at]) < 0.15 * abs(g[k][at]) + 1e-4
    assert np.allclose(before.sum(axis=1), 1, atol=1e-5)


def test_folded_tables_against_a_plain_forward_pass():
    net = Network(["a", "b"], seed=3)
    codes, _, _ = windows_of([b"The cat, 12 mats \xc3\xa9\xff" * 30, b"", b"x"])
    for row, got in zip(codes, net.folded().probabilities(codes)):
        h = []
        for k in WIDTHS:
            for f in range(FILTERS):
                sums = []
                for at in range(WINDOW - k + 1):
                    x = np.concatenate([net.p["e"][c] for c in row[at : at + k]])
                    sums.append(float(x @ net.p[f"w{k}"][:, f]))
                h.append(max(0.0, max(sums) + float(net.p[f"b{k}"][f])))
        logits = np.array(h) @ net.p["v"] + net.p["c"]
        e = np.exp(logits - logits.max())
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_sample_is_bounded_whatever_the_ids_and_copies(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(Network, "fit", lambda self, codes, y, seed=0: sizes.append((len(codes), np.bincount(y).tolist())) or self)
    rows = spark.range(100_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7L END AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('one text ', 100) ELSE concat(repeat('the cat sat ', 100), id) END AS text", "CASE WHEN id % 5 = 0 THEN 'fr' ELSE 'en' END AS lang")
    train(rows)
    train(rows, sample=100)
    train(rows.selectExpr("text", "concat('l', doc_id, length(text) % 7, text) AS lang").where("lang IS NOT NULL"), sample=60)
    assert sizes[0][0] <= SAMPLE_DOCS * SAMPLE_WINDOWS and min(sizes[0][1]) > SAMPLE_DOCS * SAMPLE_WINDOWS * 0.45
    assert sizes[1] == (400, [200, 200]) or sizes[1][0] <= 400 and sizes[1][0] > 380
    assert sizes[2][0] <= 60 * SAMPLE_WINDOWS


def test_windows_cover_whole_texts():
    codes, fill, many = windows_of([b"", b"a" * WINDOW, b"b" * (WINDOW + 1)])
    assert many.tolist() == [1, 1, 2] and fill.tolist() == [0, WINDOW, WINDOW, 1]


def test_odd_rows(spark):
    data = [(i, w * 40, lang) for i in range(30) for w, lang in (("the cat sat ", "en"), ("le chat noir é ", "fr"))]
    df = spark.createDataFrame([*data, (90, None, "en"), (91, "", None), (92, "123 !?", "en"), (None, "the cat " * 30_000, None)], "doc_id long, text string, lang string").selectExpr("*", "9 as score")
    model = train(df)
    rows = predict(df, model).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 90)
    assert [r.lang_pred for r in rows if r.doc_id in (90, 91, 92)] == ["und"] * 3
    assert [r.lang_pred for r in rows if r.doc_id is None] == ["en"]
    named = df.selectExpr("*", "1 as `a.b`", "2 as Lang_Pred", "3 as `row`", "4 as `__v`")
    out = predict(named, model)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "row", "__v", "lang_pred", "score"]
    assert [r.lang_pred for r in out.where("doc_id < 90").collect()] == [r.lang_pred for r in predict(df, model).where("doc_id < 90").collect()]
    assert train(df.limit(0)) is None
    assert {r.lang_pred for r in predict(df, None).collect()} == {"und"} and predict(df.limit(0), model).count() == 0
