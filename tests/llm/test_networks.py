"""The byte network against plain loops, and its training step against finite differences."""

import math

import numpy as np

from cohortlens.llm import langid

TEXTS = {
    "aa": ["aba cab abba bac ", "caba bab acca ", "bb aa cc ab "],
    "xx": ["xyz zyx xxy ", "zzy yxx zyz ", "yy zx xz xyx "],
    "mm": ["mno onm mmo ", "nono mom non ", "oo mn no "],
}


def plain_scores(model: langid.ByteCNN, text: str) -> list[float]:
    """Softmax of the mean of the windows' logits, each weighed by its length; byte by byte, filter by filter."""
    data = text.encode()
    overlap, size = max(langid.WIDTHS) - 1, langid.WINDOW
    starts = list(range(0, max(1, len(data) - overlap), size - overlap))
    total, weight = [0.0] * len(model.langs), 0
    for s in starts:
        window = data[s : s + size]
        padded = window + bytes(size - len(window))
        feats = []
        for w, table in model.tables.items():
            for f in range(table.shape[2]):
                feats.append(max(sum(float(table[j][padded[i + j]][f]) for j in range(w)) for i in range(size - w + 1)))
        feats = [max(0.0, v + float(b)) for v, b in zip(feats, model.bias)]
        for k in range(len(model.langs)):
            total[k] += len(window) * (sum(v * float(model.out[i][k]) for i, v in enumerate(feats)) + float(model.out_bias[k]))
        weight += len(window)
    top = max(t / weight for t in total)
    e = [math.exp(t / weight - top) for t in total]
    return [v / sum(e) for v in e]


def test_scores_equal_plain_loops(spark):
    rows = [(i * 10 + j, t * 3, lang) for i, (lang, texts) in enumerate(TEXTS.items()) for j, t in enumerate(texts)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"), epochs=2)
    asked = ["a", "xyz", "aba cab " * 40, "mno é " * 70, "ab" * 128, "ab" * 127 + "xyz", "zyx" * 300]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, text in enumerate(asked):
        want = plain_scores(model, text)
        assert abs(got[i].score - max(want)) < 1e-4
        assert want[model.langs.index(got[i].lang_pred)] > max(want) - 1e-4


def test_first_step_follows_the_gradient():
    rate, seed, width = 0.01, 11, 24
    texts = [(t, k) for k, each in enumerate(TEXTS.values()) for t in each]
    x = np.array([list(t.encode().ljust(width, b"\0")) for t, _ in texts], dtype=np.uint8)
    y = np.array([k for _, k in texts])
    model = langid.train(x, y, list(TEXTS), epochs=1, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    filters, n = langid.FILTERS * len(langid.WIDTHS), len(TEXTS)
    e = rng.normal(0, 0.3, (256, langid.EMBED))
    o = rng.normal(0, 0.2, (filters, n))
    conv = {w: rng.normal(0, 1 / np.sqrt(w * langid.EMBED), (w, langid.EMBED, langid.FILTERS)) for w in langid.WIDTHS}
    e[0] = 0
    pooled = np.array([
        np.concatenate([np.max([sum(e[row[i + j]] @ conv[w][j] for j in range(w)) for i in range(width - w + 1)], axis=0) for w in langid.WIDTHS]) for row in x
    ])

    def loss(b, o, c):
        q = np.maximum(pooled + b, 0) @ o + c
        q = q - q.max(axis=1, keepdims=True)
        return -np.mean((q - np.log(np.exp(q).sum(axis=1, keepdims=True)))[np.arange(len(y)), y])

    start = [np.zeros(filters), o, np.zeros(n)]
    for place, after in ((0, model.bias), (1, model.out), (2, model.out_bias)):
        slope = np.zeros_like(start[place])
        for at in np.ndindex(slope.shape):
            values = []
            for d in (1e-5, -1e-5):
                moved = [v.copy() for v in start]
                moved[place][at] += d
                values.append(loss(*moved))
            slope[at] = (values[0] - values[1]) / 2e-5
        clear = np.abs(slope) > 1e-4
        assert clear.any()
        # The first step of Adam is the rate against the gradient's sign.
        assert np.allclose((after - start[place])[clear], -rate * np.sign(slope)[clear], atol=1e-4)


def test_training_lowers_the_loss():
    x = np.array([list((t * 2).encode().ljust(40, b"\0")) for each in TEXTS.values() for t in each], dtype=np.uint8)
    y = np.repeat(np.arange(3), 3)

    def loss(model):
        z = model.logits(x)
        z = z - z.max(axis=1, keepdims=True)
        return float(-np.mean((z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(y)), y]))

    falls = [loss(langid.train(x, y, list(TEXTS), epochs=k)) for k in (1, 5, 20)]
    assert falls[0] > falls[1] > falls[2] and falls[2] < 0.5
    assert (langid.train(x, y, list(TEXTS), epochs=20).logits(x).argmax(axis=1) == y).all()
