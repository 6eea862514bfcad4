import random

from tallyglass.llm import quality_rules as qr


def _clean(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_measures_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", "\n\n", "a", "é ü\tñ", "x\ny\nx\n x\nx", "a b c d e f g h " * 3, "same " * 30, "#*$%&|<>", "\x1c \x1c", "  a", "y" * 9000]
    texts += [_clean(rnd, rnd.randint(1, 60)) + rnd.choice(["", "\n" + "p q r s t u v w x " * 2, " | | ###"]) for _ in range(60)]
    texts.append(_clean(rnd, 30_000))
    docs = spark.createDataFrame([(i, t, "en", "s", 5, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept int")
    for r in qr.verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == qr.brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_thresholds_adapt_to_groups(spark):
    rnd = random.Random(2)
    rows = []
    for lang, noise in (("aa", ""), ("bb", " | a | b |")):  # one language uses bars by habit
        rows += [(len(rows) + i, _clean(rnd, 80) + noise, lang, f"s{i % 2}") for i in range(300)]
    clean = len(rows)
    rows += [(clean + i, " ".join(w + "###" for w in _clean(rnd, 80).split()), "aa", "s0") for i in range(40)]
    rows += [(clean + 40 + i, _clean(rnd, 80) + " | " * 40, None, None) for i in range(2)]
    out = {r.doc_id: r for r in qr.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[i].kept for i in range(clean)) >= 0.99 * clean
    assert not any(out[i].kept for i in range(clean, clean + 40))
    assert len(out) == len(rows)


def test_empty_and_all_failing(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert qr.verdicts(spark.createDataFrame([], schema)).count() == 0
    out = qr.verdicts(spark.createDataFrame([(1, None, None, None), (1, None, None, None)], schema)).collect()
    assert [(r.base_failed, r.kept) for r in out] == [(True, False)] * 2


def _brute_verdicts(rows, prior):
    """kept by row, from weighted lists of the sketches' values."""
    import math

    measures = {i: dict(zip(qr.MEASURES, qr.measure(t.encode() if t else None))) for i, t, _, _ in rows}
    failed = {i: qr.brute(t)[5] for i, t, _, _ in rows}

    def stats(m):
        return {"symbols": m["n_symbols"] / max(m["word_chars"], 1), "dup_lines": m["n_dup_lines"] / max(m["n_lines"], 1), "word_length": m["word_chars"] / max(m["n_words"], 1)}

    def sketched(x):
        if x < qr.LEAST:
            return 0.0
        value = qr.RATIO ** math.ceil(math.log(x) / math.log(qr.RATIO)) * 2 / (1 + qr.RATIO)
        assert abs(value - x) <= 0.0101 * x
        return value

    def weighed(ids, name, above=None):
        """value -> weight of a group, with the level above as ``prior`` documents."""
        out = {}
        for i in ids:
            x = sketched(stats(measures[i])[name])
            out[x] = out.get(x, 0) + 1
        if above is not None:
            total = sum(above.values())
            for x, w in above.items():
                out[x] = out.get(x, 0) + prior * w / total
        return out

    def quantiles(group):
        total, found = sum(group.values()), []
        for q in qr.QUANTILES:
            up_to = 0
            for x in sorted(group):
                up_to += group[x]
                if up_to >= total * q - qr.SAME:
                    break
            found.append(x)
        return found

    def reach(name, qs, overall):
        _, factor, both = qr.RULES[name]
        q1, q2, q3, tail = qs
        if both:
            return factor * (q3 - q1)
        return math.inf if overall and tail <= 0 else 4 * (q3 - q2) + factor * (tail - q2)

    good = [r for r in rows if not failed[r[0]]]

    def limits(lang, source):
        out = {}
        for name, (*_, both) in qr.RULES.items():
            of_all = weighed([r[0] for r in good], name)
            of_lang = weighed([r[0] for r in good if r[2] == lang], name, of_all)
            qs = quantiles(weighed([r[0] for r in good if r[2:] == (lang, source)], name, of_lang))
            far = max(reach(name, qs, False), qr.LEAST_SHARE * reach(name, quantiles(of_all), True))
            out[name] = (qs[0] - far, qs[2] + far) if both else (-math.inf, qs[1] + far)
        return out

    known = {pair: limits(*pair) for pair in {r[2:] for r in good}}
    kept, near = {}, set()
    for i, _, lang, source in rows:
        if failed[i]:
            kept[i] = False
            continue
        x, lim = stats(measures[i]), known[lang, source]
        kept[i] = all(lim[k][0] <= x[k] <= lim[k][1] for k in x)
        if any(math.isfinite(e) and abs(x[k] - e) <= 1e-9 * abs(e) for k in x for e in lim[k]):  # rounding
            near.add(i)
    return kept, near


def test_verdicts_match_exact_quantiles_and_are_the_same_in_any_layout(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(260):
        lang, source = rnd.choice([("aa", "s0"), ("aa", "s1"), ("bb", "s0"), ("cc", None), (None, "s2")])
        noise = {"aa": rnd.choice(["", " # $"]), "bb": " | a | b " * rnd.randint(1, 4)}.get(lang, "")
        junk = "###" if rnd.random() < 0.08 else "zzzzzzzzzzzz" if rnd.random() < 0.05 else ""
        rows.append((k, " ".join(w + junk for w in _clean(rnd, rnd.randint(5, 90)).split()) + noise, lang, source))
    schema = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(rows, schema)
    first = {r.doc_id: r for r in qr.verdicts(frame.repartition(3), prior=40).collect()}
    again = {r.doc_id: r for r in qr.verdicts(frame.repartition(7, "text"), prior=40).collect()}
    assert first == again
    kept, near = _brute_verdicts(rows, 40)
    assert len(near) < 5 and not all(kept.values()) and any(kept.values())
    assert {i: first[i].kept for i in kept if i not in near} == {i: v for i, v in kept.items() if i not in near}


def test_repeats_are_counted_on_words_not_on_hashes():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    text = " ".join([a, "c d e f g h i", b, "c d e f g h i", a + b])
    assert qr.measure(text.encode())[4] == qr.brute(text)[4] == 0


def test_limits_differ_between_groups_of_every_size(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = qr.measured(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        limits = qr.thresholds(rows).collect()
        for name in ("symbols", "word_length"):
            assert len({r[f"high_{name}"] for r in limits}) > 2, (sf, name)


def test_each_document_moves_its_group(spark):
    rnd = random.Random(3)
    base = [(k, _clean(rnd, 60), "aa", f"s{k % 3}") for k in range(90)]
    wide = [(100 + k, " ".join(w * 4 for w in _clean(rnd, 60).split()), "aa", "s9") for k in range(30)]  # long words, in a small group
    schema = "doc_id long, text string, lang string, source string"
    few, many = (qr.thresholds(qr.measured(spark.createDataFrame([*base, *wide[:n]], schema))) for n in (3, 30))
    high = lambda t: {r.source: r.high_word_length for r in t.collect()}
    assert high(many)["s9"] > high(few)["s9"] >= high(few)["s0"]


def test_what_hardly_any_document_has_fails_nowhere(spark):
    rnd = random.Random(4)
    rows = [(k, _clean(rnd, 60) + (" #" if k == 5 else ""), "aa", "s") for k in range(300)]
    schema = "doc_id long, text string, lang string, source string"
    out = {r.doc_id: r.failed for r in qr.verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert "symbols" not in out[5]
    rows += [(300 + k, " ".join(w + "##" for w in _clean(rnd, 60).split()), "aa", f"t{k}") for k in range(8)]  # now there is a tail
    out = {r.doc_id: r.failed for r in qr.verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert "symbols" not in out[5] and all("symbols" in out[300 + k] for k in range(8))
