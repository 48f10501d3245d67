"""Licence scan through a positional index of rare words, in DataFrame expressions alone.

Templates (headings, grants, notices and identifiers of licences, with the base
phrases among them) are posted by word and position.  Every template has a
mandatory key phrase.  The document frequency of all key words is counted over the
whole corpus; the index posts, for each template, the ``ANCHORS`` key words of
highest IDF.  In a file, these words are looked up wherever they stand, each
posting implies the place where its template would start, and places that all
posted words of a template agree on stay.  Since an alignment must hold the whole
key phrase, this intersection loses nothing, whichever words are rare.  Then the
key phrase is verified at its place, and of a notice at least ``ENOUGH`` of the words.

The templates are data: the plan is the same for ten and for a thousand of them.
Of identifiers that begin alike the longest that stands at a place counts (MIT-0 is not
MIT), and an SPDX expression goes on with OR and AND from one identifier to the next.
Only rows that have a posted word pay for word positions.  Nothing is shuffled but
one count per key word and task, and the driver receives one row per key word.

Defined cases: null and empty texts have no words, no places and score 0; rows
and ids may repeat or be null; an empty table gives an empty result; an input
column named as a new one is replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, notice, mandatory key phrase inside it
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the mit license mit copyright c", "the mit license mit"),
    ("mit", "mit license copyright c", "mit license copyright"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    ("mit-text", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "without warranty of any kind express or implied"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "use this file except in compliance with the license"),
    ("apache-2.0", "www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "version 3 29 june 2007"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "version 2 june 1991"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", "general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "copy of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "gnu library general public license version 2 june 1991", "gnu library general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("fdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "licensed under cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "licensed under cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "names of its contributors may be used to endorse"),
    ("bsd-3-clause", "bsd 3 clause license", "bsd 3 clause"),
    ("bsd-2-clause", "bsd 2 clause license", "bsd 2 clause"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    ("isc", "isc license copyright c", "isc license copyright"),
    ("epl-2.0", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("epl-1.0", "eclipse public license v 1 0", "eclipse public license v 1 0"),
    ("cddl-1.0", "common development and distribution license cddl version 1 0", "common development and distribution license"),
    ("eupl-1.2", "european union public licence v 1 2", "european union public licence"),
    ("artistic-2.0", "the artistic license 2 0", "artistic license 2 0"),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    ("ofl-1.1", "sil open font license version 1 1", "sil open font license"),
    ("odbl", "open data commons open database license", "open database license"),
    ("python-2.0", "python software foundation license version 2", "python software foundation license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "modify and distribute this software and its documentation for any purpose"),
    ("ms-pl", "microsoft public license ms pl", "microsoft public license"),
    ("public-domain", "released into the public domain", "into the public domain"),
    ("mit", "mit license", "mit license"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib license", "zlib license"),
    ("bsd", "bsd license", "bsd license"),
    ("apache-2.0", "apache license 2 0", "apache license 2 0"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("mpl-2.0", "mpl 2 0", "mpl 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "commons attribution 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", "commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", "commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution noderivatives 4 0 international", "commons attribution noderivatives 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution noncommercial sharealike 4 0 international", "commons attribution noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution noncommercial noderivatives 4 0 international", "commons attribution noncommercial noderivatives 4 0"),
]
#: Whole licences: label, mandatory key phrase, text.
BODIES = [
    (
        "mit",
        "to deal in the software without restriction",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software""",
    ),
    (
        "isc",
        "for any purpose with or without fee is hereby granted",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to
this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
action arising out of or in connection with the use or performance of this software""",
    ),
    (
        "zlib",
        "altered source versions must be plainly marked as such",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote
the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2
altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or
altered from any source distribution""",
    ),
]
#: Identifiers behind "SPDX-License-Identifier:"; each is its own label.
SPDX = """0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause
bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 ecl-2.0 epl-1.0 epl-2.0
eupl-1.2 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ncsa odbl-1.0 ofl-1.1 openssl php-3.01 postgresql psf-2.0 unlicense
upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1""".split()
#: The part of a notice's words that must match.
ENOUGH = 0.8
#: Key words of a template that the index posts.
ANCHORS = 3


#: What a template is: a notice, an identifier behind "SPDX-License-Identifier:", or a further one of such an expression.
NOTICE, IDENTIFIER, FURTHER = range(3)


class Template(NamedTuple):
    """A phrase to find: its words, and where in it how many mandatory words stand."""

    label: str
    words: list[str]
    first: int
    size: int
    base: bool
    kind: int = NOTICE

    @property
    def key(self) -> list[str]:
        """The mandatory words."""
        return self.words[self.first : self.first + self.size]


def template(label: str, notice: str, key: str, base: bool = False) -> Template:
    """A template from its text; the key phrase counts where it first stands."""
    words, phrase = notice.split(), key.split()
    kind = IDENTIFIER if notice.startswith("spdx license identifier ") else NOTICE
    return Template(label, words, next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), len(phrase), base, kind)


def further(t: Template) -> Template:
    """An identifier after OR or AND in an expression; its first word is looked up, all must match."""
    return Template(t.label, ["or", *t.words[3:]], 1, 1, False, FURTHER)


def longer(templates: list[Template]) -> list[list[int]]:
    """Of every identifier the others that begin with all its words: where one of them stands, the shorter does not."""
    starts: dict[tuple[str, ...], list[int]] = {}
    for k, t in enumerate(templates):
        for n in range(1, len(t.words) if t.kind != NOTICE else 0):
            starts.setdefault(tuple(t.words[:n]), []).append(k)
    return [starts.get(tuple(t.words), []) if t.kind != NOTICE else [] for t in templates]


def spdx_notice(identifier: str) -> tuple[str, str, str]:
    """Label, notice and key phrase of an identifier."""
    words = "".join(c if c.isalnum() else " " for c in identifier)
    return identifier, f"spdx license identifier {words}", f"license identifier {words}"


TEMPLATES = [*NOTICES, *[(label, " ".join(text.split()), key) for label, key, text in BODIES], *map(spdx_notice, SPDX)]


def vocabulary(templates: list[Template]) -> list[str]:
    """All words of the key phrases."""
    return sorted({w for t in templates for w in t.key})


def lowered(text: Column) -> Column:
    """Lower case in which ASCII words are those of A-Z lowered alone: of other letters only the Kelvin sign has an ASCII lower case."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def words_of(text: Column) -> Column:
    """Words of a text."""
    return F.array_remove(F.split(lowered(text), GAP), "")


def document_frequency(docs: DataFrame, words: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of ``docs``, and in how many each word occurs."""
    found = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, words)))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count()
    rows = {r.w: r["count"] for r in counted.collect()}
    return rows.get("", 0), {w: rows.get(w, 0) for w in words}


def postings(templates: list[Template], n: int, df: dict[str, int], anchors: int = ANCHORS) -> dict[str, list[tuple[int, int]]]:
    """By word, (template, place in it) of the index; by template, its key words of highest IDF, ties by word and place."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        idf = lambda i, t=t: (-math.log((n + 1) / (df.get(t.words[i], 0) + 1)), t.words[i], i)
        for i in sorted(range(t.first, t.first + t.size), key=idf)[:anchors]:
            index.setdefault(t.words[i], []).append((k, i))
    return index


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES, enough: float = ENOUGH) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``places``.

    ``places`` array<struct<label, word, part>> has every alignment of a notice: its
    first word (below zero where it would begin before the text) and the part of
    the notice's words that match.  All other columns stay; one of the same name is replaced.
    """
    known = [*[template(label, phrase, phrase, True) for phrase, label in base.items()], *[template(*t) for t in dict.fromkeys(templates)]]
    known += [further(t) for t in known if t.kind == IDENTIFIER]
    own = docs.select(docs[text].cast("string").alias("text"))
    index = postings(known, *document_frequency(own, vocabulary(known)))
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    kept = [i for i, c in enumerate(docs.columns) if c not in new]
    given = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    given = given.select(*[f"c{i}" for i in kept], words_of(F.col(f"c{docs.columns.index(text)}").cast("string")).alias("words"))

    strings = lambda xs: F.array(*map(F.lit, xs))
    posted = F.create_map(*[x for w in sorted(index) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("i")) for k, i in index[w]]))])
    table = F.array(*[F.struct(F.lit(t.label).alias("label"), strings(t.words).alias("words"), strings(t.key).alias("key"), F.lit(t.first).alias("first"), F.lit(min(t.size, ANCHORS)).alias("anchors"), F.lit(t.base).alias("base"), F.lit(t.kind).alias("kind"), F.array(*map(F.lit, more)).cast("array<int>").alias("longer")) for t, more in zip(known, longer(known), strict=True)])
    of = lambda c: F.get(table, c.t)

    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s.w.isin(*sorted(index)))
    given = given.withColumn("at", F.when(F.arrays_overlap("words", strings(sorted(index))), placed))
    implied = F.flatten(F.transform("at", lambda s: F.transform(F.element_at(posted, s.w), lambda p: F.struct(p.t.alias("t"), (s.i - p.i).alias("start")))))
    given = given.withColumn("implied", F.array_sort(implied))
    # equal starts stand together: those that all posted words of the template imply stay, each once
    agreed = F.filter("implied", lambda c, i: (F.get(F.col("implied"), i + of(c).anchors - 1) == c) & ((i == 0) | (F.get(F.col("implied"), i - 1) != c)))
    sure = F.filter(agreed, lambda c: F.when(c.start + of(c).first >= 0, F.slice("words", c.start + of(c).first + 1, F.size(of(c).key)) == of(c).key).otherwise(False))
    empty = F.array().cast("array<struct<start:int,t:int>>")
    given = given.withColumn("found", F.coalesce(F.array_sort(F.transform(sure, lambda c: F.struct(c.start.cast("int").alias("start"), c.t.alias("t")))), empty))
    # a further identifier stands with all its words behind OR or AND, the longest match of a place counts, and an expression goes on from an identifier
    rest = lambda c: F.slice("words", c.start + 2, F.size(of(c).words) - 1) == F.slice(of(c).words, F.lit(2), F.size(of(c).words) - 1)
    fits = lambda c: (of(c).kind != FURTHER) | ((c.start > 0) & F.get("words", c.start).isin("or", "and") & rest(c))
    given = given.withColumn("found", F.filter("found", fits))
    given = given.withColumn("found", F.filter("found", lambda c: ~F.exists("found", lambda d: (d.start == c.start) & F.array_contains(of(c).longer, d.t))))
    goes_on = lambda s, c: F.when(of(c).kind == FURTHER, F.array_contains(s.ends, c.start)).otherwise(True)
    ends = lambda s, c: F.when(goes_on(s, c) & (of(c).kind != NOTICE), F.array_append(s.ends, (c.start + F.size(of(c).words)).cast("int"))).otherwise(s.ends)
    kept_on = lambda s, c: F.when(goes_on(s, c), F.array_append(s.kept, c)).otherwise(s.kept)
    start = F.struct(F.array().cast("array<int>").alias("ends"), empty.alias("kept"))
    chained = F.aggregate("found", start, lambda s, c: F.struct(ends(s, c).alias("ends"), kept_on(s, c).alias("kept")), lambda s: s.kept)
    given = given.withColumn("sure", F.when(F.exists("found", lambda c: of(c).kind == FURTHER), chained).otherwise(F.col("found")))

    def part(c: Column) -> Column:
        there = lambda i: (c.start + i >= 0) & (c.start + i < F.size("words"))
        same = F.transform(of(c).words, lambda w, i: F.when(there(i), F.get("words", c.start + i) == w).otherwise(False))
        return F.when(of(c).kind == FURTHER, 1.0).otherwise(F.size(F.filter(same, lambda x: x)) / F.size(of(c).words))

    scored = F.transform(F.filter("sure", lambda c: ~of(c).base), lambda c: F.struct(of(c).label.alias("label"), c.start.cast("long").alias("word"), part(c).alias("part")))
    given = given.withColumn("places", F.array_distinct(F.filter(scored, lambda s: s.part >= enough))).withColumn("base", F.filter("sure", lambda c: of(c).base))
    base_labels = F.array_distinct(F.transform("base", lambda c: of(c).label))
    found = given.select(
        *[f"c{i}" for i in kept],
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda c: c.start)).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda c: c.start)).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base_labels)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base_labels, F.transform("places", lambda s: s.label)))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("places", lambda s: s.part)), F.lit(0.0))).alias("score"),
        "places",
    )
    return found.toDF(*[docs.columns[i] for i in kept], *new)
