"""Licence notices: ordered signature rules behind a keyword gate; contained weaker detections give way. DataFrame functions only."""

from __future__ import annotations

from functools import cache
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.arrays import bind
from tidemill.llm.common import Scratch


class Rule(NamedTuple):
    """A regular expression over normalised words (lower case, one space between and around them)."""

    label: str
    pattern: str
    rank: int  # a detection gives way to one of higher rank around it
    sure: float

    @property
    def keywords(self) -> tuple[tuple[str, ...], ...]:
        """Of each of these lists every match holds a string, so that texts without them need not be tried."""
        return _required(self.pattern)


# Phrases of the base detection and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label, how notices name the licence, its short identifier in words, its address in words.
FAMILIES = (
    ("mit", r"mit(?: x11)?", r"mit", r"opensource org licenses mit"),
    ("mit-0", r"mit no attribution|mit 0", r"mit 0", r"opensource org licenses mit 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)? (?:version |v )?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version| v)? (?:2(?: 0)?|v2(?: 0)?)", r"apache 2(?: 0)?", r"apache org licenses license 2 0"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("bsd-0-clause", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd", r"opensource org licenses 0bsd"),
    ("gpl-1", r"(?:gnu )?general public license(?: version| v)? (?:1|v1)(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2", r"(?:gnu )?gpl ?v? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:2|v2)(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", r"(?:gnu )?gpl ?v? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-3", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:3|v3)(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?v? ?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public license(?: version| v)? (?:2 1|v2 1)", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", r"(?:gnu )?lgpl ?v? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl-3", r"(?:gnu )?lesser general public license(?: version| v)? (?:3|v3)(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("agpl-3", r"(?:gnu )?agpl ?v? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl-3", r"(?:gnu )?affero general public license(?: version| v)? (?:3|v3)(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("gfdl", r"(?:gnu )?free documentation license", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl 1 [123]"),
    ("mpl-1.1", r"mozilla public license(?: version| v)? 1 1", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2", r"mozilla public license(?: version| v)? 2(?: 0)?", r"mpl 2 0", r"mozilla org (?:mpl|en us mpl) 2 0"),
    ("mpl-2", r"mpl ?v? ?2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1", r"eclipse public license(?: version| v)? 1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2", r"eclipse public license(?: version| v)? 2(?: 0)?", r"epl 2 0", r"eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1", r"common development and distribution license(?: version)?(?: 1(?: 0)?)?", r"cddl 1 0", r"opensource org licenses cddl 1 0"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)?(?: 1 2)?", r"eupl 1 2", r"joinup ec europa eu collection eupl"),
    ("isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses zlib"),
    ("bsl-1", r"boost software license(?: version)?(?: 1(?: 0)?)?", r"bsl 1 0", r"boost org license 1 0"),
    ("artistic-2", r"(?:perl )?artistic(?: license)?(?: version)? 2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic 2 0"),
    ("unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl", r"wtfpl", r"wtfpl net"),
    ("python-2", r"python(?: software foundation)?(?: license)?(?: version)? 2(?: 0)?", r"python 2 0|psf 2 0", r"opensource org licenses python 2 0"),
    ("postgresql", r"postgresql", r"postgresql", r"opensource org licenses postgresql"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)?(?: 1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", r"opensource org licenses ncsa"),
    ("upl-1", r"universal permissive license(?: version)?(?: 1(?: 0)?)?", r"upl 1 0", r"opensource org licenses upl"),
    ("ms-pl", r"microsoft public license", r"ms pl", r"opensource org licenses ms pl"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"cc by(?: [1-4] [05])?(?! nc| nd| sa)", r"cc by [1-4] [05]", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?(?! nd| sa)", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?! non ?commercial| no ?deriv| share ?alike)", r"cc by [1-4] [05]", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?! no ?deriv| share ?alike)", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("public-domain", r"(?:the )?public domain(?: dedication)?", r"public domain", r"creativecommons org publicdomain mark 1 0"),
    ("gpl", r"(?:gnu )?gpl(?! ?v? ?[123])", r"gpl", r"gnu org licenses gpl html"),
    ("gpl", r"(?:gnu )?general public license(?! version| v| [123])", r"gpl", r"gnu org licenses gpl html"),
    ("apache", r"apache(?: software)?(?! license version| license v| version| v| [12])", r"apache", r"apache org licenses(?! license)"),
    ("bsd", r"bsd(?! [0234] clause)", r"bsd", r"opensource org licenses bsd license"),
)

# Forms of notice, as (pattern around the name, which part of the family it takes, rank, certainty).
FORMS = (
    ("spdx license identifier (?:{x})", "short", 5, 1.0),
    ("(?:https? )?(?:www )?(?:{x})", "address", 4, 0.95),
    ("(?:licen[sc]ed|released|distributed|redistributed|available|provided|published|offered|covered|shared|governed) (?:by|under)"
     " (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?(?:{x})(?: licen[sc]e)?", "name", 4, 0.9),
    ("(?:subject to|pursuant to|in accordance with|according to|see) (?:the )?(?:terms of )?(?:the )?(?:{x})(?: licen[sc]e)?", "name", 3, 0.8),
    ("under (?:the )?(?:terms of )?(?:the |an? )?(?:{x}) licen[sc]e", "name", 3, 0.8),
    ("licen[sc]es? (?:is |type |name )?(?:{x})", "short", 2, 0.7),
    ("(?:{x}) licen[sc]ed?", "name", 2, 0.6),
)

# What the licences' own texts and usual headers say, with label, rank and certainty.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 6, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 6, 0.8),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 6, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6, 0.9),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from this software without specific prior written permission", 6, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment", 6, 0.95),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 6, 0.95),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 6, 0.95),
    ("apache-2", "you may not use this file except in compliance with the license", 6, 0.8),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 6, 0.85),
    ("apache-2", "apache license version 2 0 january 2004", 6, 1.0),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 5, 0.95),
    ("gpl-2", "gnu general public license version 2 june 1991", 6, 1.0),
    ("gpl-3", "gnu general public license version 3 29 june 2007", 6, 1.0),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 5, 0.85),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 6, 1.0),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", 6, 1.0),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", 6, 1.0),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 6, 0.95),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 6, 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 6, 1.0),
    ("epl-1", "the accompanying program is provided under the terms of this eclipse public license", 6, 0.8),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", 6, 0.95),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 6, 0.8),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 6, 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6, 1.0),
    ("wtfpl", "do what the fuck you want to public license", 6, 1.0),
    ("ofl-1.1", "this license is copied below and is also available with a faq at", 6, 0.8),
    ("ofl-1.1", "sil open font license version 1 1 26 february 2007", 6, 1.0),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 7, 0.95),
    ("artistic-2", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", 6, 1.0),
    ("python-2", "psf is making python available to licensee on an as is basis", 6, 0.95),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", 6, 0.95),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", 5, 0.5),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 6, 0.9),
    ("upl-1", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 6, 0.9),
)


def rules() -> list[Rule]:
    """Every form of notice for every family, then the texts; each expression once."""
    found = {}
    for label, name, short, address in FAMILIES:
        part = {"name": name, "short": short, "address": address}
        for form, takes, rank, sure in FORMS:
            pattern = "(?<= )" + form.replace("{x}", part[takes]) + "(?= )"
            found.setdefault((label, pattern), Rule(label, pattern, rank, sure))
    for label, text, rank, sure in TEXTS:
        found.setdefault((label, text), Rule(label, f"(?<= ){text}(?= )", rank, sure))
    return list(found.values())


@cache
def _required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Lists of strings; whatever the expression matches, with the spaces it looks at, holds a string of each list."""
    lists: list[tuple[str, ...]] = []

    def least(items) -> list[tuple[str, ...]]:
        """The lists of a sequence: its runs of fixed characters, and where it branches, the branches' runs together."""
        out, run = [], ""

        def close():
            nonlocal run
            if run:
                out.append((run,))
            run = ""

        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
            elif name in ("ASSERT", "SUBPATTERN"):
                inner = value[-1]
                if all(str(k) == "LITERAL" for k, _ in inner):
                    run += "".join(chr(v) for _, v in inner)
                else:
                    close()
                    out += least(inner)
            elif name == "BRANCH":
                close()
                best = [max(least(b), key=lambda ws: min(map(len, ws)), default=None) for b in value[1]]
                if all(best):
                    out.append(tuple(sorted({w for ws in best for w in ws})))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                close()
                if value[0] > 0:
                    out += least(value[2])
            elif name != "ASSERT_NOT":
                close()
        close()
        return out

    for runs in least(parser.parse(pattern)):
        words = tuple(sorted({max(run.split(" "), key=len) for run in runs}))  # one word of a run, so that rules share their strings
        if min(map(len, words)) > 2 and words not in lists:
            lists.append(words)
    return tuple(lists)


def words_of(text: Column) -> Column:
    """A-Z in lower case, words with one space between; a word is a run of letters, digits and anything beyond ASCII."""
    odd = text.contains("K") | text.contains("İ")  # the two characters beyond ASCII whose lower case holds ASCII
    lower = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i):
        same = words[i] == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & (words[i + k] == p)
        return same

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, detections) of whole texts.

    Documents: id, ``text_hash``, ``n_words``, and of the base phrases ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels`` (sorted array), a row for each input row. Detections: id, ``text_hash``, ``label``, ``rank``, ``sure``, ``begin`` and
    ``end`` (characters of the normalised words, from 0) and ``kept``; a row for each match of a rule in each different (id, text).

    A rule's expression is tried only where the strings occur that every match of it holds. A detection is kept unless another of higher rank covers
    its interval, or one of the same rank covers it and is longer; equal intervals of the same rank all stay.

    Null text is empty. Null ids are ids like any other, repeated rows are repeated in documents, other columns are not read. An empty
    table gives no rows in either.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = base.select(id_column, F.xxhash64("__text").alias("text_hash"), words_of(F.col("__text")).alias("__w"))
    base = base.withColumn("__s", F.concat(F.lit(" "), "__w", F.lit(" ")))
    wide = F.col("__s")
    # octets, as a space is one octet: the number of words without making them
    n_words = F.when(F.col("__w") == "", 0).otherwise(F.octet_length("__w") - F.octet_length(F.replace(F.col("__w"), F.lit(" "))) + 1)

    has = {phrase: wide.contains(f" {phrase} ") for phrase, _ in BASE}
    none = F.array().cast("array<int>")
    some = has[BASE[0][0]]
    for p, _ in BASE[1:]:
        some = some | has[p]
    places = F.when(some, bind(F.split(F.col("__w"), " ", -1), lambda words: F.concat(*[_starts(words, p) for p, _ in BASE]))).otherwise(none)
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in BASE])))

    listed = rules()
    keys = sorted({w for r in listed for words in r.keywords for w in words})
    number = {k: i for i, k in enumerate(keys)}
    table = F.array(*[F.struct(
        F.array(*[F.array(*[F.lit(number[w]) for w in words]) for words in r.keywords]).alias("keywords"), F.lit(r.pattern).alias("pattern"),
        F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.lit(r.sure).alias("sure")) for r in listed])
    present = F.filter(F.transform(F.array(*[F.lit(k) for k in keys]), lambda k, i: F.when(wide.contains(k), i)), lambda i: i.isNotNull())

    def tried(known):
        return F.filter(F.transform(
            F.filter(table, lambda r: F.forall(r["keywords"], lambda words: F.arrays_overlap(words, known))),
            lambda r: F.struct(
                r["label"].alias("label"), r["rank"].alias("rank"), r["sure"].alias("sure"),
                F.transform(F.split(wide, r["pattern"], -1), lambda x: F.length(x)).alias("gaps"),
                F.transform(F.regexp_extract_all(wide, r["pattern"], F.lit(0)), lambda x: F.length(x)).alias("sizes"))),
            lambda r: F.size(r["sizes"]) > 0)

    found = base.select(
        id_column, "text_hash", n_words.cast("bigint").alias("n_words"), places.alias("__places"), base_labels.alias("base_labels"),
        bind(present, tried).alias("__tried"))
    found = scratch.write(found, "licence-scan")

    documents = found.select(
        id_column, "text_hash", "n_words", F.size("__places").cast("bigint").alias("n_base"),
        F.array_min("__places").cast("bigint").alias("first_word"), F.array_max("__places").cast("bigint").alias("last_word"), "base_labels")

    hits = found.select(id_column, "text_hash", "__tried").distinct().select(id_column, "text_hash", F.posexplode("__tried").alias("rule", "r")).select(
        id_column, "text_hash", "rule", "r.label", "r.rank", "r.sure", F.posexplode(F.arrays_zip("r.gaps", "r.sizes")).alias("nth", "m"))
    hits = hits.select("*", F.col("m.gaps").alias("gap"), F.col("m.sizes").alias("size")).where("size IS NOT NULL").drop("m")
    key = [F.col(id_column), F.col("text_hash")]
    in_rule = Window.partitionBy(*key, "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_rule)).withColumn("begin", F.col("end") - F.col("size"))
    # sorted so that whatever covers an interval comes before it; equal intervals are peers in the default frame
    outer = Window.partitionBy(*key).orderBy("begin", F.desc("end"))
    ranks = sorted({r.rank for r in listed})
    kept = F.lit(True)
    for rank in ranks:
        reach = F.max(F.when(F.col("rank") > rank, F.col("end"))).over(outer)
        same_rank = F.max(F.when(F.col("rank") == rank, F.struct(F.col("end").alias("end"), (-F.col("begin")).alias("back")))).over(outer)
        longer = (same_rank["end"] > F.col("end")) | ((same_rank["end"] == F.col("end")) & (-same_rank["back"] < F.col("begin")))
        kept = F.when(F.col("rank") == rank, ~F.coalesce(reach >= F.col("end"), F.lit(False)) & ~F.coalesce(longer, F.lit(False))).otherwise(kept)
    detections = hits.select(id_column, "text_hash", "label", "rank", "sure", "begin", "end", kept.alias("kept"))
    return documents, detections


def summary(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with the base phrases' figures, all labels that stay, and the certainty of the surest notice.

    The score is 0 without any label; a base phrase counts 0.9.
    """
    documents, detections = scan(docs, id_column, text)
    found = detections.where("kept").groupBy(F.col(id_column).alias("__id"), F.col("text_hash").alias("__th")).agg(
        F.collect_set("label").alias("__labels"), F.max("sure").alias("__sure"))
    joined = documents.join(found, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__th")), "left")
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("__labels", empty))))
    score = F.greatest(F.coalesce("__sure", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))
    return joined.select(id_column, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                         F.array_join(labels, ",").alias("labels"), score.alias("score"))
