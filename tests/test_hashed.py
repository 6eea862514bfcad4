import hashlib
import math
import re

from tallyglass.operators import hashed


def _brute(texts, part_words):
    """Vectors from the definition."""
    cut = {}
    for key, text in texts:
        w = re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        cut[key] = [w[i : i + part_words] for i in range(0, max(len(w), 1), part_words)]
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    coded = {k: [[x % hashed.CODES for x in [*map(number, w), *(number(a) * hashed.PAIR + number(b) for a, b in zip(w, w[1:]))]] for w in own] for k, own in cut.items()}
    n, df = sum(map(len, coded.values())), {}
    for own in coded.values():
        for part in own:
            for c in set(part):
                df[c] = df.get(c, 0) + 1
    out = {}
    for k, own in coded.items():
        mean = [0.0] * hashed.DIM
        for part in own:
            x = [0] * hashed.DIM
            for c in part:
                x[c % hashed.DIM] += round((1 + math.log((1 + n) / (1 + df[c]))) * hashed.SCALE) * (1 if c // hashed.DIM % 2 == 0 else -1)
            norm = math.sqrt(sum(a * a for a in x))
            mean = [m + (a / norm if norm else 0) / len(own) for m, a in zip(mean, x, strict=True)]
        out[k] = mean
    return out


def test_equals_brute_force(spark):
    texts = [(1, "The cat sat on the mat"), (2, "the CAT"), (3, None), (4, " -- é"), (5, "w" * 500), (6, " ".join(f"t{i % 23}" for i in range(100))), (7, "Ünder_score KK"), (None, "the mat")]
    frame = spark.createDataFrame(texts, "id long, content string")
    for n in (1, 7, 256):
        got = {r.id: r.vector for r in hashed.embed_hashed(frame, part_words=n).collect()}
        want = _brute(texts, n)
        assert got.keys() == want.keys()
        assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True)), n
    assert hashed.embed_hashed(frame.limit(0)).count() == 0


def test_weights_are_bounded_and_rare_words_weigh_more(spark):
    frame = spark.createDataFrame([(i, f"common rare{i}") for i in range(50)], "id long, content string")
    counts = hashed.frequencies(hashed.parts(frame, "id", "content"))
    w = abs(hashed.weights(counts))
    code = int(hashlib.md5(b"common").hexdigest()[:8], 16) % hashed.CODES
    assert w[code] == w.min() == hashed.SCALE and len(w) == hashed.CODES >= counts.count()


def test_like_texts_are_near(spark):
    docs = spark.createDataFrame([(1, "parse the token stream of a query"), (2, "parse a token stream of the query"), (3, "colour gamut of printed photographs")], "id long, content string")
    v = {r.id: r.vector for r in hashed.embed_hashed(docs).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(1, 2) > dot(1, 3) + 0.2
