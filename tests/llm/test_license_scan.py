import re

from tallyglass.llm import license_scan as ls

SF = "/root/testdata/sf0.01"


def test_every_known_sentence_is_found_wrapped_or_commented():
    for name, forms in ls.SENTENCES.items():
        for form in forms:
            assert ls._TRIGGER.search(form), form
            words = form.split()
            wrapped = "\n".join("# " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
            for text in (form, form.upper(), "Some prose here.\n" + form + "\nMore.", wrapped, f"no stop before\n{form}"):
                assert [n for _, n in ls.recognise(text)] == [name], text


def test_rules_are_ordered_sequences():
    s = {k: v[0] for k, v in ls.SENTENCES.items()}
    bsd = [s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert ls.match(ls.recognise("\n".join(bsd))) == ["BSD-3-Clause"]
    assert ls.match(ls.recognise("\n".join(bsd[:3]))) == ["BSD-2-Clause"]
    assert ls.match(ls.recognise("\n".join(reversed(bsd)))) == []
    far = "\n".join([bsd[0], *["Other words."] * 9, *bsd[1:3]])
    assert ls.match(ls.recognise(far)) == []
    both = f"{s['mit-name']} {s['apache-name']} {s['mit-name']}"
    assert ls.match(ls.recognise(both)) == ["MIT", "MIT", "Apache-2.0"]
    assert ls.match(ls.recognise(s["apache-name"] + "\n" + s["apache-comply"] + "\nYou may get a copy elsewhere.\n" + s["apache-as-is"])) == ["Apache-2.0"]


def test_query_finds_the_planted_lines(spark):
    known = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "All rights reserved.": "All-Rights-Reserved",
    }
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in ls.op4(spark, SF).collect()}
    assert len(out) == len(texts)
    for i, text in texts.items():
        lines = [known[x] for x in re.split(r"\n", text) if x in known]
        named = set(lines) if set(lines) <= ls.ONLY_ALONE else set(lines) - ls.ONLY_ALONE
        assert out[i].licences == ",".join(sorted(named)) and out[i].n_sentences == len(lines)
    assert any("All-Rights-Reserved" in r.licences for r in out.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "licence " * 50_000, 1), (4, "License: MIT", 1), (4, "License: MIT", 1)], "doc_id long, text string, sentences int")
    out = sorted((r.doc_id, list(r.sentences), list(r.licences)) for r in ls.scan(docs).collect())
    assert out == [(1, [], []), (2, [], []), (3, [], []), (4, ["mit-name"], ["MIT"]), (4, ["mit-name"], ["MIT"])]
    assert ls.scan(docs.limit(0)).count() == 0


def test_sentences_wrapped_anywhere_are_found():
    for name, forms in ls.SENTENCES.items():
        for form in forms:
            words = form.split()
            for n in (1, 2, 3, 5):
                wrapped = "\n".join(" * " + " ".join(words[i : i + n]) for i in range(0, len(words), n))
                assert [x for _, x in ls.recognise(f"Before.\n{wrapped}\nAfter.")] == [name], wrapped


def test_more_families_and_named_holders():
    s = {k: v[0] for k, v in ls.SENTENCES.items()}
    bsd = [s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary")]
    for holder in ("Example Corp.", "the University of Somewhere"):
        clause = f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        assert ls.match(ls.recognise("\n".join([*bsd, clause]))) == ["BSD-3-Clause"]
    for name, text in (("AGPL-3.0", s["agpl3-grant"]), ("LGPL-2.1", s["lgpl21-grant"]), ("LGPL-3.0", s["lgpl3-grant"]), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later")):
        assert ls.match(ls.recognise(text)) == [name]


def test_reserved_rights_stand_only_alone():
    s = {k: v[0] for k, v in ls.SENTENCES.items()}
    for text in ("All rights reserved.", "Copyright (c) 2020 Some Body, Inc. All Rights Reserved.", "// Copyright 2021-2023 Some Body - all rights reserved", "All\nrights\nreserved"):
        assert ls.match(ls.recognise(text)) == ["All-Rights-Reserved"], text
    for text in ("All rights are hers, and reserved is he.", "He reserved all rights", "copyright"):
        assert ls.match(ls.recognise(text)) == [], text
    bsd = "\n".join(["Copyright (c) 2020 Some Body. All rights reserved.", s["bsd-redistribution"], s["bsd-source"], s["bsd-binary"]])
    assert ls.match(ls.recognise(bsd)) == ["BSD-2-Clause"]


def _brute_match(sequence):
    """The rules by trying every choice of places, the earliest first."""
    free, out = [True] * len(sequence), []

    def follow(rule, used):
        if len(used) == len(rule):
            return used
        for at in range(used[-1] + 1, len(sequence)):
            if free[at] and sequence[at][1] == rule[len(used)] and sequence[at][0] - sequence[used[-1]][0] <= ls.MAX_GAP + 1:
                return follow(rule, used + [at])
        return None

    for licence, rule in ls.RULES:
        for start in range(len(sequence)):
            if licence in ls.ONLY_ALONE and out:
                break
            if free[start] and sequence[start][1] == rule[0] and (used := follow(rule, [start])):
                for u in used:
                    free[u] = False
                out.append(licence)
    return out


def test_matching_and_recognition_match_brute_force():
    import random

    rnd = random.Random(3)
    forms = {ls.normalise(f): name for name, fs in ls.SENTENCES.items() for f in fs}
    ids = list(ls.SENTENCES)
    for _ in range(300):
        chosen = [rnd.choice(ids) if rnd.random() < 0.5 else rnd.choice(["mit-grant", "mit-notice", "as-is-mit", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "apache-name", "apache-comply"]) if rnd.random() < 0.7 else None for _ in range(rnd.randint(0, 12))]
        text = "\n".join(rnd.choice(ls.SENTENCES[c]) if c else "Some other words here." for c in chosen)
        want = [(i, c) for i, c in enumerate(chosen) if c]
        got = ls.recognise(text)
        assert [n for _, n in got] == [n for _, n in want]
        assert all(forms.get(ls.normalise(line)) == c for line, c in zip(text.split("\n"), chosen) if c)
        assert ls.match(got) == _brute_match(got)


def test_many_known_sentences_take_linear_time():
    import time

    s = ls.SENTENCES["mit-grant"][0]
    spent = []
    for n in (2000, 8000):
        found = ls.recognise("\n".join([s] * n))
        began = time.process_time()
        assert ls.match(found) == []
        spent.append(time.process_time() - began)
    assert spent[1] < 10 * max(spent[0], 0.01)
