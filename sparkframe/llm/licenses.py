"""License scans by ordered signature rules.

Hundreds of signatures are regular expressions over a text's words: sentences of the licenses' own
texts, written out by hand, and families of names times phrasings. A family's rules run on a text only if it holds the family's keyword, and, for names that say
too little alone, a beginning of the phrasings. Detections carry a priority; one that lies within another of the same or a higher priority is
suppressed. Everything is a Spark expression over one row: no user functions and no shuffle.

Defined results: null, empty and blank texts have no words and no labels; equal rows are scanned
alike; extra columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkframe.llm.columns import carried, let

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, the beginning of a word or words that a text must hold, and the name as words.
FAMILIES = (
    ("mit", "mit ", "mit(?: x11)?"),
    ("mit", "expat ", "expat(?: x11)?"),
    ("apache", "apache ", "apache(?: software)?"),
    ("apache-2.0", "apache ", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("bsd", "bsd ", "bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd ", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    ("0bsd", "0bsd ", "0bsd"),
    ("gpl", "general public ", "(?:gnu )?general public"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public ", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("gpl-3.0", "general public ", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("lgpl", "lesser general public ", "(?:gnu )?lesser general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23])?(?: [01])?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: ?v?3)?(?: 0)?"),
    ("gfdl", "free documentation ", "(?:gnu )?free documentation"),
    ("mpl", "mozilla ", "mozilla public"),
    ("mpl-2.0", "mozilla ", "mozilla public license(?: version)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", "mpl(?: v)? ?2(?: 0)?"),
    ("epl", "eclipse ", "eclipse(?: public)?"),
    ("epl-2.0", "eclipse ", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("cddl", "cddl ", "cddl(?: 1 [01])?"),
    ("cddl", "common development and distribution ", "common development and distribution"),
    ("cpl", "common public ", "common public"),
    ("eupl", "european union public ", "european union public"),
    ("artistic", "artistic ", "(?:perl )?artistic"),
    ("zlib", "zlib ", "zlib(?: libpng)?"),
    ("isc", "isc ", "isc"),
    ("boost", "boost software ", "boost software"),
    ("unlicense", "unlicense ", "the unlicense"),
    ("wtfpl", "wtfpl ", "wtfpl"),
    ("postgresql", "postgresql ", "postgresql"),
    ("python", "python ", "python(?: software foundation)?"),
    ("ruby", "ruby ", "ruby"),
    ("php", "php ", "php"),
    ("openssl", "openssl ", "openssl"),
    ("ofl", "open font ", "(?:sil )?open font"),
    ("odbl", "open database ", "open database"),
    ("odc-by", "open data commons attribution ", "open data commons attribution"),
    ("cc0", "cc0 ", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons zero ", "creative commons zero"),
    ("cc-by", "cc by ", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa ", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc ", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd ", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa ", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd ", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution ", "creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons attribution ", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons attribution ", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons attribution ", "creative commons attribution no ?deriv(?:ative|ative works|atives|s)(?: [1-4] [05])?"),
    ("public-domain", "public domain ", "public domain"),
    ("proprietary", "proprietary ", "proprietary(?: and confidential)?"),
    ("reserved", "all rights reserved ", "all rights reserved"),
)
#: Sentences that only a license's own text has, by label: a part of the grant, conditions or disclaimer, as words.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and ?or sell copies"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission to use copy modify and ?or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use copy modify and ?or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of [^|]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache", "this product includes software developed (?:by|at) the apache (?:software foundation|group)"),
    ("gpl", "is free software you can redistribute it and ?or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl", "the precise terms and conditions for copying distribution and modification follow pay close attention to the difference between a work based on the library"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute and ?or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("ofl", "this license allows the licensed fonts to be used studied modified and redistributed freely as long as they are not sold by themselves"),
    ("odbl", "is made available under the open database license any rights in individual contents of the database are licensed under the database contents license"),
    ("cc0", "to the extent possible under law [^|]{1,80} has waived all copyright and related or neighboring rights to"),
    ("cc-by", "this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?license"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", "has been placed in the public domain"),
    ("public-domain", "hereby dedicates? (?:any and all copyright interest in )?the software to the public domain"),
    ("reserved", "no part of this publication may be reproduced"),
    ("reserved", "no part of this book may be reproduced"),
    ("proprietary", "confidential and proprietary (?:information|property) of"),
    ("proprietary", "unauthorized copying of this (?:file|software|document)"),
)
#: What may stand before a name; every phrasing has one of these or a word beginning with "licen".
TERMS_OF = ("governed by", "subject to", "according to", "in accordance with", "under")
#: How a name is used: a rank (lower goes first), a weight, and the words around the name.
PHRASINGS = (
    (0, 1.0, "(?:licensed|released|distributed|published|provided|available|covered)(?: as is)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}(?: licen[cs]e)?(?: version [1-9](?: [0-9])?)?"),
    (1, 0.95, "spdx licen[cs]e identifier {name}"),
    (2, 0.9, "{name} licen[cs]e(?: version [1-9](?: [0-9])?| agreement)?"),
    (3, 0.8, "licen[cs]e {name}"),
    (4, 0.7, f"(?:{'|'.join(TERMS_OF)}) (?:the )?(?:terms of )?(?:the )?{{name}}(?: licen[cs]e)?"),
)
#: Names that say enough alone, with no phrase around them.
STANDALONE = ("0bsd", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "gpl", "gpl-2.0", "gpl-3.0", "lgpl", "agpl", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "mpl-2.0", "reserved", "wtfpl")
_RANKS = len(PHRASINGS) + 1
#: The rank of sentences: those of a license's own text go before what is said about it.
_OWN_TEXT = 0


def _opening(pattern: str) -> str:
    """The words that a sentence begins with, up to the first that may differ."""
    plain = re.match(r"[a-z0-9 ]*", pattern)[0]
    if plain == pattern:
        return plain
    certain = plain[:-1] if pattern[len(plain)] == "?" else plain
    return certain.rpartition(" ")[0] + " "


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regular expression, rank, weight) of every signature, in order."""
    out = [(label, key, p.replace("{name}", name), rank, weight) for rank, weight, p in PHRASINGS for label, key, name in FAMILIES]
    out += [(label, key, name, _RANKS - 1, 0.6) for label, key, name in FAMILIES if label in STANDALONE]
    return [(label, _opening(p), p, _OWN_TEXT, 1.0) for label, p in SENTENCES] + out


#: Beginnings of words, one of which any signature with a phrase around its name has.
_PHRASES = ("licen", *(f"{x} " for x in TERMS_OF))


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with a blank before, between and after them.

    Other letters may be lower-cased too; they differ from those of any name or phrase. The Kelvin
    sign alone has an ASCII letter for its lower case, and is put away first.
    """
    t = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), SEPARATOR, " ")


def _places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after another."""
    want = phrase.split(" ")
    hit = lambda w, i: [F.get(words, i + k) == x for k, x in enumerate(want)]

    def here(w, i):
        test = w == want[0]
        for more in hit(w, i)[1:]:
            test = test & F.coalesce(more, F.lit(False))
        return F.when(test, i.cast("long"))

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def _matches(joined: Column, rule: Column) -> Column:
    """(begin, end, ...) of each match of a rule, from the lengths of what lies between matches."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.call_function("regexp_extract_all", joined, pattern, F.lit(0))

    def located(parts: Column) -> Column:
        between, hits = parts["between"], parts["hits"]
        step = F.transform(hits, lambda h, k: F.struct((F.char_length(F.get(between, k)) + F.coalesce(F.char_length(F.get(hits, k - 1)), F.lit(0))).alias("skip"), F.char_length(h).alias("n")))
        none = F.expr("cast(array() as array<struct<begin:int,low:int,rank:int,label:string,weight:double>>)")

        def add(state, x):
            at = state["at"] + x["skip"]
            one = F.struct(at.alias("begin"), (-(at + x["n"])).alias("low"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight"))
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]

    split = F.call_function("split", joined, pattern, F.lit(-1))
    return let(F.struct(split.alias("between"), found.alias("hits")), located)


def _surviving(found: Column) -> Column:
    """Labels and the greatest weight of detections that don't lie within another of the same or a higher rank.

    In order of begin, then longest first, one that reaches no further than the furthest so far of a
    rank as good lies within it.
    """
    state = F.struct(F.array_repeat(F.lit(-1), _RANKS).alias("ends"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))

    def add(s, x):
        end = -x["low"]
        inside = F.exists(F.slice(s["ends"], 1, x["rank"] + 1), lambda e: e >= end)
        ends = F.transform(s["ends"], lambda e, k: F.when(k == x["rank"], F.greatest(e, end)).otherwise(e))
        kept = F.struct(ends.alias("ends"), F.array_union(s["labels"], F.array(x["label"])).alias("labels"), F.greatest(s["score"], x["weight"]).alias("score"))
        return F.when(inside, s).otherwise(kept)

    return F.aggregate(F.sort_array(found), state, add)


def _rule_table(some) -> Column:
    """Signatures by keyword: (keyword, rules)."""
    by_key: dict[str, list] = {}
    for a, k, p, r, w in some:
        by_key.setdefault(k, []).append(F.struct(F.lit(a).alias("label"), F.lit(p).alias("pattern"), F.lit(r).alias("rank"), F.lit(w).alias("weight")))
    return F.array(*[F.struct(F.lit(f" {k}").alias("keyword"), F.array(*v).alias("rules")) for k, v in by_key.items()])


def detect(text: Column) -> Column:
    """A struct: n_words and found, a struct of places (of base phrases), base, labels, score."""
    none = F.expr("cast(array() as array<string>)")
    nowhere = F.expr("cast(array() as array<bigint>)")
    empty = F.struct(nowhere.alias("places"), none.alias("base"), none.alias("labels"), F.lit(0.0).alias("score"))
    # Without a phrase, only sentences, and names that say enough alone, can be found.
    sentences, more = len(SENTENCES), rules()
    alone, phrased = _rule_table(r for k, r in enumerate(more) if k < sentences or r[3] == _RANKS - 1), _rule_table(more)

    def scanned(joined: Column) -> Column:
        words = F.split(F.trim(joined), " ")
        at = lambda p: F.when(F.contains(joined, F.lit(f" {p} ")), let(words, lambda w: _places(w, p))).otherwise(nowhere)
        places = F.array(*[at(p) for p, _ in BASE])
        asked = lambda table: F.flatten(F.transform(F.filter(table, lambda r: F.contains(joined, r["keyword"])), lambda r: r["rules"]))
        has_phrase = functools.reduce(lambda a, b: a | b, [F.contains(joined, F.lit(f" {x}")) for x in _PHRASES])

        def combined(x: Column) -> Column:
            base = F.filter(F.array(*[F.when(F.size(x["places"][k]) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda y: y.isNotNull())
            found = F.flatten(F.transform(x["asked"], lambda r: _matches(joined, r)))
            whole = let(F.struct(base.alias("base"), _surviving(found).alias("s")), lambda y: F.struct(F.flatten(x["places"]).alias("places"), F.array_sort(y["base"]).alias("base"), F.array_sort(F.array_union(y["base"], y["s"]["labels"])).alias("labels"), F.when(F.size(y["base"]) > 0, F.greatest(F.lit(0.6), y["s"]["score"])).otherwise(y["s"]["score"]).alias("score")))
            return F.when((F.size(x["asked"]) == 0) & (F.size(F.flatten(x["places"])) == 0), empty).otherwise(whole)

        n = F.char_length(joined) - F.char_length(F.replace(joined, F.lit(" "), F.lit(""))) - 1
        found = let(F.struct(places.alias("places"), F.when(has_phrase, asked(phrased)).otherwise(asked(alone)).alias("asked")), combined)
        return F.struct(n.cast("long").alias("n_words"), found.alias("found"))

    return let(normal(text), scanned)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and the scan's columns."""
    d = carried(docs, d=detect(F.col(f"`{text}`")))
    f = F.col("d.found")
    return d.select(
        "row",
        F.col("d.n_words").alias("n_words"),
        F.size(f["places"]).cast("long").alias("n_base"),
        F.array_min(f["places"]).alias("first_word"),
        F.array_max(f["places"]).alias("last_word"),
        F.array_join(f["base"], ",").alias("base_labels"),
        F.array_join(f["labels"], ",").alias("labels"),
        f["score"].alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
