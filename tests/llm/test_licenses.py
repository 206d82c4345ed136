"""Base phrases and suppression against plain loops; every rule can fire and its gate lets it."""

import random
import re

from presssignal.llm import licenses
from presssignal.llm.license_rules import CLAUSES, NAMED, rules


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases(documents):
    draw = random.Random(2)
    bits = ["MIT", "license", "License", "apache", "general", "public", " ", "-", "\n", "\x00", "é", "_", "mit license", "GENERAL public LICENSE", "licenses", "7"]
    rows = [(i, " ".join(draw.choices(bits, k=draw.randrange(25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "The MIT-License"), (502, "mit license " * 50_000), (502, "mit license " * 50_000)]
    got = licenses.scan(documents(rows).selectExpr("*", "1 AS labels", "2 AS raw")).collect()
    mine = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert mine == sorted(repr((d, *brute_base(t))) for d, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 0) == (not r.labels)


def plain_suppressed(found):
    return sorted(
        d for d in set(found) if not any(o[2] < d[2] and o[0] <= d[0] and d[1] <= o[1] for o in found)
    )


def test_suppression():
    draw = random.Random(7)
    for _ in range(300):
        found = list({(s := draw.randrange(20), s + draw.randrange(1, 10), draw.randrange(6)) for _ in range(draw.randrange(15))})
        assert sorted(licenses.suppressed(found)) == plain_suppressed(found)


def test_rules_are_many_and_gated_soundly():
    every = rules()
    assert len(every) > 300
    open_gate = licenses.Scanner([type(r)(r.label, r.weight, ("e",), r.pattern) for r in every])
    gated = licenses.Scanner()
    texts = ["e SPDX-License-Identifier: MIT", "e under the Apache License, Version 2.0", "e see http://www.gnu.org/licenses/gpl-3.0.html"]
    for label, _, name, tag, _, address in NAMED:
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", name)
        texts += [f"e spdx-license-identifier: {re.sub(r'[\\]', '', tag)}", f"e licensed under the {plain} license e"]
    texts += [f"e {key} {pattern}" for _, key, pattern in CLAUSES]
    hits = 0
    for text in texts:
        want = open_gate.detections(text.lower())
        assert gated.detections(text.lower()) == want, text
        hits += bool(want)
    assert hits > 100


def test_labels_and_priority():
    scanner = licenses.Scanner()

    def labels(text):
        return [(scanner[r].label, text[s:e]) for s, e, r in scanner.detections(text.lower())]

    assert labels("SPDX-License-Identifier: Apache-2.0") == [("apache-2.0", "SPDX-License-Identifier: Apache-2.0")]
    assert {x for x, _ in labels("Licensed under the MIT License.")} == {"mit"}
    assert [x for x, _ in labels("the GNU General Public License v2")][0] == "gpl-2.0"
    assert [x for x, _ in labels("Apache License, Version 2.0")] == ["apache-2.0"]
    assert "mit" in {x for x, _ in labels("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files")}
    assert labels("wir gehen mit dem Hund") == [] and labels("") == []


def written(nodes, draw):
    """A text that the parsed pattern ``nodes`` matches, alternatives and repeats drawn."""
    out = ""
    for op, arg in nodes:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "NOT_LITERAL" | "ANY":
                out += "x"
            case "IN":
                kind, value = draw.choice(arg)
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(draw.randint(*value)), "CATEGORY": lambda: "x" if "NOT" in str(value) else draw.choice(" \n\t")}[str(kind)]()
            case "BRANCH":
                out += written(draw.choice(arg[1]), draw)
            case "SUBPATTERN":
                out += written(arg[3], draw)
            case "MAX_REPEAT" | "MIN_REPEAT":
                least, most, inner = arg
                out += "".join(written(inner, draw) for _ in range(draw.randint(least, min(most, least + 2))))
            case "AT" | "ASSERT_NOT":
                pass
            case other:
                raise ValueError(other)
    return out


def test_gate_lets_every_form_of_every_rule():
    every, scanner, draw = rules(), licenses.Scanner(), random.Random(5)
    patterns = [re.compile(licenses.spaced(r.pattern), re.DOTALL) for r in every]
    matched = 0
    for i, p in enumerate(patterns):
        for _ in range(12):
            text = f"e {written(re._parser.parse(p.pattern, re.DOTALL), draw)} e"
            want = licenses.suppressed([(m.start(), m.end(), k) for k, q in enumerate(patterns) for m in q.finditer(text)])
            assert sorted(scanner.detections(text)) == sorted(want), (every[i], text)
            matched += bool(p.search(text))
    assert matched > 11 * len(every)


def test_wrapped_headers():
    scanner = licenses.Scanner()
    for text, label in (
        ("// Redistribution\n// and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("# Permission is\n# hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("licensed under the GNU General\n# Public License version 2", "gpl-2.0"),
        ("see https://opensource.org/license/mit", "mit"),
        ("This work is licensed under CC Zero License", "cc0-1.0"),
    ):
        assert label in {scanner[r].label for _, _, r in scanner.detections(text.lower())}, text


def test_empty_table(documents):
    assert licenses.scan(documents([])).collect() == []
