import re

from fixtures import ascii_lower, clashing, frame, prose

from tidemill.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """All columns of the summary but the id, the long way."""
    words = WORD.findall(ascii_lower(text or ""))
    places, base = [], set()
    for phrase, label in lic.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    wide = " " + " ".join(words) + " "
    found = []
    for r in lic.rules():  # no prefilter here
        found += [(m.start(), m.end(), r) for m in re.finditer(r.pattern, wide)]

    def weaker(a, b, r):
        return any(x <= a and b <= y and (o.rank > r.rank or (o.rank == r.rank and y - x > b - a)) for x, y, o in found)

    kept = [r for a, b, r in found if not weaker(a, b, r)]
    labels = base | {r.label for r in kept}
    score = max([r.sure for r in kept] + [0.9 if places else 0.0])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


TEXTS = [
    None, "", " ,;\n", "no notice at all", "Released under the MIT License.", "under the mit license under the MIT license, under; the\nmit -- license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "apache license version 2 and cc by nc", "CC-BY-NC cc by nc-sa 4.0 licence", "cc by nc cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 licence",
    "SPDX-License-Identifier: BSD-3-Clause", "see https://www.apache.org/licenses/LICENSE-2.0 or opensource.org/licenses/MIT", "license: MIT, license: zlib", "mit und mit dem Hund nach Hause",
    "dedicated to the public domain license", "governed by the Mozilla Public License 2.0 license", "distributed under a Creative Commons Attribution-NonCommercial 4.0 International licence",
    "Kunder the mit license", "under the mit licenseé", "naïve under the Kmit license", "İ under the mit license", "licensed under the mit license mit license mit license",
    prose(3, 8000) + " released under the apache license version 2 " + prose(4, 3000), "licensed under mit " * 3000, "subject to the gpl v3 license",
]


def test_matches_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, TEXTS[5]), (None, TEXTS[5]), (6, "another text of the same id, under the mit license")]
    got = lic.summary(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain(t))) for i, t in rows)


NOTICES = {
    "https://www.mozilla.org/en-US/MPL/2.0/": "mpl-2", "http://scripts.sil.org/OFL": "ofl-1.1", "http://www.wtfpl.net": "wtfpl",
    "https://joinup.ec.europa.eu/collection/eupl": "eupl-1.2", "https://www.eclipse.org/legal/epl-v10.html": "epl-1",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0", "SPDX-License-Identifier: PSF-2.0": "python-2", "Licensed under the 0BSD license": "bsd-0-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
    "you may not use this file except in compliance with the License.": "apache-2", "This is free and unencumbered software released into the public domain.": "unlicense",
}


def test_notices_get_their_labels(spark):
    rows = list(enumerate(NOTICES))
    got = {r.doc_id: r.labels.split(",") for r in lic.summary(frame(spark, rows)).collect()}
    assert {t: label for (i, t), label in zip(rows, NOTICES.values()) if label not in got[i]} == {}
    assert sorted((r.doc_id, *plain(t)) for (i, t), r in zip(rows, sorted(lic.summary(frame(spark, rows)).collect(), key=lambda r: r.doc_id))) == sorted(
        tuple(r) for r in lic.summary(frame(spark, rows)).collect())


def test_rules_are_many_and_ordered():
    listed = lic.rules()
    assert len(listed) > 300 and all(re.compile(r.pattern) for r in listed)
    assert len({(r.label, r.pattern) for r in listed}) == len(listed)


def test_every_rule_has_keywords_that_its_matches_hold():
    texts = [" " + " ".join(WORD.findall(ascii_lower(t or ""))) + " " for t in [*TEXTS, *NOTICES, *[t for _, t, _, _ in lic.TEXTS]]]
    tried = 0
    for r in lic.rules():
        assert r.keywords
        for t in texts:
            for m in re.finditer(r.pattern, t):
                around = t[m.start() - 1:m.end() + 1]
                assert all(any(w in around for w in words) for words in r.keywords), (r, around)
                tried += 1
    assert tried > 60


def test_detections_tell_what_gave_way(spark):
    _, found = lic.scan(frame(spark, [(1, "Licensed under the MIT License")]))
    rows = found.collect()
    assert [(r.label, r.rank) for r in rows if r.kept] == [("mit", 4)] and {r.rank for r in rows if not r.kept} == {2, 3}
    assert all(0 <= r.begin < r.end for r in rows)


def test_empty_and_clashing(spark):
    assert lic.summary(frame(spark, [])).collect() == []
    got = lic.summary(clashing(spark, [(1, "under the mit license")], "labels", "rank", "begin", "text_hash", "n_words", "__w")).collect()
    assert [(r.doc_id, r.labels) for r in got] == [(1, "mit")]


def test_main_path_has_no_python(spark):
    plan = lic.summary(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
