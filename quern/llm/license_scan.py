"""License scans by a positional rare-token index.

Templates are passages of licences.  Their words are ordered by inverse document frequency over the scanned corpus; postings
(word, template, place) of the rarest of each template form the index, as many as any COVER of its words must share one with.
Of each file that holds a mandatory key phrase, all index words of that phrase's licence are looked up; file place minus
template place gives the shifts at which a template may stand.  There all its words are compared: the part that agrees is
the score.  A licence is named if its score reaches COVER; without a key phrase it cannot be, so no other word is looked up.

The corpus decides which words are looked up, not what is found: a text has the same labels and score in any corpus.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


COVER = 0.5

#: Base phrases and their labels (fixed values of the contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (mandatory key phrases, any one of them; passages of the licence and of the notices that name it, in lower-case words)
TEMPLATES = {
    "mit": (
        ["permission is hereby granted free of charge", "mit license", "to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies", "the software is provided as is without warranty of any kind express or implied"],
        [
            "released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ],
    ),
    "apache": (
        ["apache license", "apache org licenses license 2 0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "unless required by applicable law or agreed to in writing software distributed under the license"],
        [
            "licensed under the apache license version 2 0",
            "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
            "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work",
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
            "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",
        ],
    ),
    "gpl": (
        ["gnu general public license", "general public license"],
        [
            "this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
            "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
            "the gnu general public license is a free copyleft license for software and other kinds of works",
        ],
    ),
    "lgpl": (
        ["lesser general public license", "library general public license"],
        [
            "under the terms of the gnu lesser general public license as published by the free software foundation",
            "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
            "you should have received a copy of the gnu lesser general public license along with this library",
        ],
    ),
    "agpl": (
        ["affero general public license"],
        [
            "under the terms of the gnu affero general public license as published by the free software foundation",
            "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
        ],
    ),
    "bsd": (
        ["redistribution and use in source and binary forms", "bsd license", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software without specific prior written permission", "this software is provided by the copyright holders and contributors as is"],
        [
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "released under the bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        ],
    ),
    "mpl": (
        ["mozilla public license"],
        [
            "this source code form is subject to the terms of the mozilla public license v 2 0",
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ],
    ),
    "isc": (
        ["permission to use copy modify and or distribute this software", "the author disclaims all warranties with regard to this software"],
        [
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            "provided that the above copyright notice and this permission notice appear in all copies",
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ],
    ),
    "zlib": (
        ["this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such"],
        [
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
            "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
            "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ],
    ),
    "boost": (["boost software license"], ["distributed under the boost software license version 1 0"]),
    "epl": (["eclipse public license"], ["this program and the accompanying materials are made available under the terms of the eclipse public license"]),
    "unlicense": (
        ["released into the public domain"],
        [
            "this is free and unencumbered software released into the public domain",
            "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ],
    ),
    "cc": (
        ["creative commons"],
        [
            "this work is licensed under a creative commons attribution 4 0 international license",
            "this work is licensed under a creative commons attribution 4 0 international license you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material",
        ],
    ),
}

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS), lambda w: w != "")


def _vocabulary() -> list[str]:
    return sorted({w for _, passages in TEMPLATES.values() for p in passages for w in p.split()})


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def word_weights(docs: DataFrame) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each template word, over all of docs."""
    held = docs.select(F.array_intersect(_words(F.coalesce("text", F.lit(""))), _strings(_vocabulary())).alias("held"))
    counts = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in counts.collect()}  # at most one row a template word, and "" for all
    return {w: log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in _vocabulary()}


def _templates() -> list[tuple[str, list[str]]]:
    return [(label, passage.split()) for label, (_, passages) in TEMPLATES.items() for passage in passages]


#: Added to places, so that a shift and its template fit one positive long: shifts from -_ZERO on.
_ZERO = 1 << 16


def _postings(weights: dict[str, float]) -> dict[str, list[int]]:
    """Of each index word, template * 2^32 + _ZERO - place of each of its postings.

    Of a template of n words the n - ceil(COVER n) + 1 rarest: any ceil(COVER n) of its words hold one of them.
    """
    out: dict[str, list[int]] = {}
    for number, (_, words) in enumerate(_templates()):
        rare = sorted(range(len(words)), key=lambda i: (-weights[words[i]], i))[: len(words) - ceil(COVER * len(words)) + 1]
        for i in sorted(rare):
            out.setdefault(words[i], []).append((number << 32) + _ZERO - i)
    return out


def license_places(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of places: label, start), base_labels, labels and score of each row of docs.

    The score is the greatest part of a template of a licence whose key phrase stands that agrees with the text, word by word at one
    shift; 0 where that stays below COVER.  A null text is empty; rows are taken one by one, also where ids repeat.  Words are counted from 0.
    """
    postings = _postings(word_weights(docs))
    templates = _templates()
    words = F.col("words")
    got = docs.select("doc_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    got = got.withColumn("known", F.array_intersect(words, _strings(sorted(postings))))
    known = F.size("known") > 0
    previous = lambda i, by: F.get(words, i - by)
    base = F.filter(
        F.transform(
            words,
            lambda w, i: F.when((w == "license") & (previous(i, 1) == "mit"), F.struct(F.lit("mit").alias("label"), (i - 1).alias("start")))
            .when((w == "license") & (previous(i, 1) == "apache"), F.struct(F.lit("apache").alias("label"), (i - 1).alias("start")))
            .when((w == "license") & (previous(i, 1) == "public") & (previous(i, 2) == "general"), F.struct(F.lit("gpl").alias("label"), (i - 2).alias("start"))),
        ),
        lambda p: p.isNotNull(),
    )
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrases = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(f" {p} ").alias("phrase")) for label, (keys, _) in TEMPLATES.items() for p in keys))
    got = got.withColumn("text", F.when(known, text))
    verified = F.array_distinct(F.transform(F.filter(phrases, lambda p: F.contains(F.col("text"), p["phrase"])), lambda p: p["label"]))
    none = lambda kind: F.array().cast(kind)
    got = got.withColumn("verified", F.when(known, verified).otherwise(none("array<string>")))
    own_words = F.array(*(F.struct(F.lit(label).alias("label"), _strings(sorted({w for own, t in templates if own == label for w in t} & postings.keys())).alias("words")) for label in TEMPLATES))
    looked_up = F.array_distinct(F.flatten(F.transform(F.filter(own_words, lambda t: F.array_contains("verified", t["label"])), lambda t: t["words"])))
    found = F.size("verified") > 0
    got = got.withColumn("top", F.when(found, F.array_intersect(looked_up, F.col("known"))))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda s: F.array_contains("top", s["word"]))
    index = F.create_map(*(x for w, codes in sorted(postings.items()) for x in (F.lit(w), F.array(*map(F.lit, codes)))))
    number = lambda c: F.shiftright(c, 32).cast("int")
    label_of = F.array(*(F.lit(label) for label, _ in templates))
    # shifts as longs, so that distinct ones are found by hashing
    shifts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["word"]), lambda c: c + h["at"]))))
    shifts = F.filter(shifts, lambda c: F.array_contains("verified", F.get(label_of, number(c))))
    body = F.array(*(_strings(t) for _, t in templates))

    def covered(c: Column) -> Column:
        shift = (c.bitwiseAND(F.lit(0xFFFFFFFF)) - _ZERO).cast("int")
        own = F.get(body, number(c))
        agree = F.filter(own, lambda w, i: F.get(words, shift + i).eqNullSafe(w))
        return F.size(agree) / F.size(own)

    fits = F.transform(shifts, lambda c: F.struct(F.get(label_of, number(c)).alias("label"), covered(c).alias("cover")))
    marked = got.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.when(F.array_contains(words, "license"), base).otherwise(none("array<struct<label:string,start:int>>")).alias("base"),
        F.when(found, F.filter(fits, lambda f: f["cover"] >= COVER)).otherwise(none("array<struct<label:string,cover:double>>")).alias("fits"),
    )
    based = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    named = F.array_distinct(F.transform("fits", lambda f: f["label"]))
    return marked.select(
        "doc_id",
        "n_words",
        "base",
        based.alias("base_labels"),
        F.array_sort(F.array_union(based, named)).alias("labels"),
        F.coalesce(F.array_max(F.transform("fits", lambda f: f["cover"])), F.lit(0.0)).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    starts = F.transform("base", lambda p: p["start"])
    return license_places(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
