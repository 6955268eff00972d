"""Licence scan with a positional index of rare template words.

Templates are passages of public licences: usual notices and sentences of their bodies.  Every word
has an inverse document frequency over the passages, and its postings are the (passage, position)
pairs where it stands.  The ``RARE_WORDS`` licence words of a text that have the highest IDF are looked
up, and hits of one passage that agree in relative position (text word minus passage word) are
intersected: a passage is found where MIN_AGREEING or more agree in one offset, and its licence is
reported where the passage's mandatory key phrases stand in the text.  A body passage so names a
licence whose name the text never mentions, and a key phrase alone names none.  The score is the
largest share of a found passage's IDF that agrees.

The index is a constant of the plan, bounded by the template list; the scan is one projection of
built-in functions over whole texts, without a shuffle.  Hits are packed into whole numbers and
sorted, so that a text of many hits costs little more than sorting them.  Texts in which no passage's
key phrases stand are not looked up, as nothing found could be verified: words are sought as plain
bytes, each once, before the patterns are tried.

Defined results: null and empty texts have no words, no labels and score 0; an empty table gives an
empty one; repeated rows give repeated rows; very long texts are read whole; other columns stay, but
columns named as a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, passage, mandatory key phrases): usual notices, and sentences of the licences' bodies, in lower case without punctuation.
PASSAGES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version", ("remotely through a computer network",)),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ("each contributor hereby grants",)),
    ("artistic-2.0", "licensed under the artistic license 2 0", ("artistic license 2 0",)),
    ("artistic-2.0", "you may distribute verbatim copies of the source form of the standard version of this package without restriction provided that you duplicate all of the original copyright notices and associated disclaimers", ("standard version of this package",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "binary forms")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", ("accompanying documentation covered by this license",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc-by-4.0", "licensed under cc by 4 0 creative commons attribution 4 0 international license", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0 creative commons attribution noncommercial 4 0 international license", ("cc by nc 4",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0 creative commons attribution noncommercial noderivatives 4 0 international license", ("cc by nc nd",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0 creative commons attribution noncommercial sharealike 4 0 international license", ("cc by nc sa",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0 creative commons attribution noderivatives 4 0 international license", ("cc by nd",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0 creative commons attribution sharealike 4 0 international license", ("cc by sa",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license the license", ("common development and distribution license",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("eupl-1.2", "licensed under the european union public licence eupl version 1 2", ("european union public licence",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3")),
    ("isc", "distributed under the isc license", ("isc license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("lgpl-2.1", "free software licensed under the gnu lesser general public license version 2 1", ("lesser general public license", "version 2 1")),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("lesser general public license", "either version 2 1")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("deal in the software without restriction",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl",)),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license microsoft public license ms pl", ("microsoft public license",)),
    ("odbl-1.0", "this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license", ("open database license",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below", ("open font license",)),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without a written agreement",)),
    ("python-2.0", "this license agreement is between the python software foundation and the individual or organization licensee accessing and otherwise using python software in source or binary form", ("python software foundation",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("compiled binary for any purpose",)),
    ("wtfpl", "do what the fuck you want to public license", ("fuck you want to",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("will the authors be held liable",)),
)
#: So many looked-up words of one passage must agree in relative position.
MIN_AGREEING = 3
#: The look-up takes so many licence words of a text, those of highest IDF.
RARE_WORDS = 48
#: A hit is passage * PASSAGE + (text word - passage word + MIDDLE) * PLACE + passage word.
PASSAGE, MIDDLE, PLACE = 1 << 48, 1 << 30, 1 << 12
#: The ASCII characters between words, one by one: Java tests such a class with one look into a bit set, ranges one after the other.
_GAPS = "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum())
GAP, WORD_CHAR = f"[{_GAPS}]", f"[^{_GAPS}]"


def phrase_pattern(phrase: str) -> str:
    """A Java pattern for the consecutive words of a phrase, A-Z in either case.

    The look-behind stands after the first letter, so most positions fail before it is tried.
    """
    words = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in phrase.split()]
    first = words[0][: words[0].index("]") + 1] if phrase[0].isalpha() else words[0][0]
    words[0] = first + f"(?<!{WORD_CHAR}{first})" + words[0][len(first) :]
    return f"{GAP}+".join(words) + f"(?!{WORD_CHAR})"


def holds(text: Column, low: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text; its words are sought as plain bytes of the lower-cased text first."""
    there = F.lit(True)
    for w in sorted(phrase.split(), key=lambda w: (-len(w), w)):
        there = there & low.contains(w)
    return F.when(there, text.rlike(phrase_pattern(phrase))).otherwise(False)


def count_words(text: Column) -> Column:
    """The number of words: each becomes one character, with what stands before it; a last word of our own ends the text."""
    return (F.length(F.regexp_replace(F.concat(text, F.lit(" a")), f"{GAP}*{WORD_CHAR}+", ".")) - 1).cast("long")


def build_index(passages: tuple = PASSAGES) -> tuple[dict[str, list[tuple[int, int]]], dict[str, float], list[float]]:
    """Postings of the passages' words, their IDF, and each passage's total IDF."""
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, text, _) in enumerate(passages):
        for i, w in enumerate(re.findall(WORD, text)):
            where[w].append((k, i))
    idf = {w: round(math.log((1 + len(passages)) / len({k for k, _ in p})), 6) for w, p in where.items()}
    return dict(where), idf, [round(sum(idf[w] for w in re.findall(WORD, text)), 6) for _, text, _ in passages]


def _agreeing(words: Column, passages: tuple) -> Column:
    """The hits, packed and sorted, that agree with MIN_AGREEING - 1 others or more."""
    postings, idf, _ = build_index(passages)
    # as one text: thousands of literals made one by one take seconds
    entry = lambda w, p: f"'{w}', named_struct('order', {-idf[w]!r}D, 'at', array({', '.join(f'{k * PASSAGE - i * (PLACE - 1)}L' for k, i in p)}))"
    table = F.expr(f"map({', '.join(entry(w, p) for w, p in postings.items())})")
    known = F.filter(F.transform(F.array_distinct(words), lambda w: F.struct(table[w].alias("found"), w.alias("w"))), lambda x: x["found"].isNotNull())
    rare = F.slice(F.sort_array(F.transform(known, lambda x: F.struct(x["found"]["order"].alias("order"), x["w"].alias("w"), x["found"]["at"].alias("at")))), 1, RARE_WORDS)

    def hits(chosen: Column) -> Column:
        held, names = F.map_from_arrays(F.transform(chosen, lambda x: x["w"]), F.transform(chosen, lambda x: x["at"])), F.transform(chosen, lambda x: x["w"])
        placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: F.array_contains(names, x["w"]))
        packed = F.transform(placed, lambda x: F.transform(held[x["w"]], lambda p: p + (x["i"] + MIDDLE) * PLACE))
        return F.sort_array(F.flatten(packed))

    def together(found: Column) -> Column:
        key = lambda i: F.shiftright(F.get(found, i), 12)
        last = MIN_AGREEING - 1
        return F.filter(found, lambda x, i: F.exists(F.sequence(F.lit(0), F.lit(last)), lambda d: key(i - d) == key(i - d + last)))

    return F.transform(F.transform(F.array(rare), hits), together)[0]


def _anchors(passages: tuple) -> list[str]:
    """The longest words of the key phrases that hold no base phrase."""
    base = [f" {p} " for p, _ in BASE_PHRASES]
    return sorted({max(k.split(), key=lambda w: (len(w), w)) for _, _, keys in passages for k in keys if not any(b in f" {k} " for b in base)})


def _labels_by_index(text: Column, low: Column, passages: tuple, words_held: Column, base_held: list[Column]) -> Column:
    """Array of struct (label, score) of the passages found; words_held: which of the anchors the text holds, base_held: which base phrases."""
    anchors = _anchors(passages)
    _, idf, totals = build_index(passages)
    weights = F.expr(f"array({', '.join('array(' + ', '.join(f'{idf[w]!r}D' for w in re.findall(WORD, p)) + ')' for _, p, _ in passages)})")
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0)

    @cache
    def keyed(keys: tuple) -> Column:
        out = F.lit(True)
        for k in keys:
            base = [held for (p, _), held in zip(BASE_PHRASES, base_held, strict=True) if f" {p} " in f" {k} "]
            first = base[0] if base else F.get(words_held, F.lit(anchors.index(max(k.split(), key=lambda w: (len(w), w)))))
            out = out & F.when(first, holds(text, low, k)).otherwise(False)
        return out

    def found(agreeing: Column) -> Column:
        # of each passage every word counts once, however many offsets it agrees in
        places = F.array_distinct(F.transform(agreeing, lambda x: F.shiftright(x, 48) * PLACE + x % PLACE))
        share = lambda k: F.aggregate(F.filter(places, lambda p: F.floor(p / PLACE) == k), F.lit(0.0), lambda a, p: a + F.get(F.get(weights, F.lit(k)), (p % PLACE).cast("int")))
        one = lambda k, label, keys: F.when(
            F.exists(places, lambda p: F.floor(p / PLACE) == k) & keyed(keys), F.struct(F.lit(label).alias("label"), F.least(F.lit(1.0), F.round(share(k) / totals[k], 4)).alias("score")))
        return F.filter(F.array(*[one(k, label, keys) for k, (label, _, keys) in enumerate(passages)]), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<label: string, score: double>>")
    needed = F.lit(False)
    for keys in sorted({keys for _, _, keys in passages}):
        needed = needed | keyed(keys)
    return F.when(needed, F.transform(F.array(_agreeing(words, passages)), found)[0]).otherwise(none)


def scan_licenses(df: DataFrame, text: str = "text", passages: tuple = PASSAGES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score (see the module)."""
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    # lower() also changes other letters, which only lets more texts through to the patterns
    df = df.withColumn("__text", body).withColumn("__low", F.lower("__text"))
    body, low = F.col("__text"), F.col("__low")
    df = df.withColumn("n_words", count_words(body))
    places, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for k, (phrase, label) in enumerate(BASE_PHRASES):
        pattern = phrase_pattern(phrase)
        # the texts between matches; null where there is none
        df = df.withColumn(f"__cut{k}", F.when(holds(body, low, phrase), F.split(body, pattern, -1)))
        cut = F.col(f"__cut{k}")
        places = places + F.when(cut.isNotNull(), F.size(cut) - 1).otherwise(0)
        firsts.append(count_words(cut[0]))
        lasts.append(F.col("n_words") - count_words(F.element_at(cut, -1)) - len(phrase.split()))
        labels.append(F.when(cut.isNotNull(), F.lit(label)))
    df = df.withColumn("__words", F.array(*[low.contains(w) for w in _anchors(passages)]))
    held = [F.col(f"__cut{k}").isNotNull() for k in range(len(BASE_PHRASES))]
    df = df.withColumn("__found", _labels_by_index(body, low, passages, F.col("__words"), held))
    base = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return (
        df.withColumn("n_base", places)
        .withColumn("first_word", F.least(*firsts))
        .withColumn("last_word", F.greatest(*lasts))
        .withColumn("base_labels", F.array_join(F.array_sort(base), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("__found", lambda x: x["label"])))), ","))
        .withColumn("score", F.greatest(F.when(places > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0))))
        .drop("__text", "__low", "__words", "__found", *[f"__cut{k}" for k in range(len(BASE_PHRASES))])
    )
