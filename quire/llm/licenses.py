"""License scans by diagonal voting, in DataFrame functions.

The rolling word hashes of every text are joined to their positions in the
templates; votes are summed by diagonal (place in the text less place in the
template); neighbouring diagonals of one template, which words more or less
give, are merged in bands as wide as the template is long; those with too few
votes are left out; and the words that voted are compared for the spans that
remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Words of a gram: of phrases, which may have two words only, and of notices and licenses.
PHRASE_GRAM = 2
NOTICE_GRAM = 3
#: Share of a notice's words that must stand in place for its label.
AGREE = 0.7

#: Exact phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public notices and licenses, in words as the scan reads them, matched up to a few changed words.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
        "mit-text",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0-header",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        "gpl-3.0-header",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-2-clause-text",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
        "isc-text",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
        "zlib-text",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0",
        "mpl-2.0-header",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        "bsd-third-clause",
    ),
    (
        "this is free and unencumbered software released into the public domain "
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law",
        "unlicense-text",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works "
        "of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
        "bsl-1.0-text",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation",
        "lgpl-header",
    ),
    (
        "you should have received a copy of the gnu affero general public license along with this program",
        "agpl-notice",
    ),
    (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "cc-by-4.0",
    ),
    (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "cc-by-sa-4.0",
    ),
)


def templates(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Rows (v, k, q, t, size, need, label, exact, gram): where each gram of k words stands in each template. As many as the templates have words.

    need: the least votes that a span of the template can have; every gram of a
    phrase, and of a notice as many as cover its share of words.
    """
    rows = [(i, text.split(), label, exact) for i, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices])]
    if short := [" ".join(w) for _, w, _, exact in rows if len(w) < (PHRASE_GRAM if exact else NOTICE_GRAM)]:
        raise ValueError(f"templates need {PHRASE_GRAM} words, notices {NOTICE_GRAM}: {short}")
    grams = []
    for i, w, label, exact in rows:
        k = PHRASE_GRAM if exact else NOTICE_GRAM
        need = len(w) - k + 1 if exact else -(-int(AGREE * len(w)) // k)
        grams += [(k, q, i, len(w), need, label, exact, w[q : q + k]) for q in range(len(w) - k + 1)]
    df = spark.createDataFrame(grams, "k int, q int, t int, size int, need int, label string, exact boolean, gram array<string>")
    parts = [df.where(F.col("k") == k).withColumn("v", F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(k)])) for k in (PHRASE_GRAM, NOTICE_GRAM)]
    return parts[0].unionByName(parts[1])


def _hits(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each gram of a text that is a template's, with its words, and one without a template for each text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    base = C.let(base, _w=C.words(C.ascii_lower(F.col("_text")), C.NOT_WORD)).drop("_text")
    rows = base.select("doc_id", "text_key", "_w", F.explode(F.sequence(F.lit(0), F.size("_w"))).alias("_p"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), C.gram_at(F.col("_w"), F.col("_p"), k).alias("v")) for k in (PHRASE_GRAM, NOTICE_GRAM)])
    rows = rows.select("doc_id", "text_key", "_w", "_p", F.explode(each).alias("_g")).select("doc_id", "text_key", "_w", "_p", F.col("_g.k").alias("_k"), F.col("_g.v").alias("_v"))
    # The row past the last word has no hash: it stays, once for each text.
    mark = (F.col("_p") == F.size("_w")) & (F.col("_k") == PHRASE_GRAM)
    met = rows.join(F.broadcast(known), (F.col("_v") == F.col("v")) & (F.col("_k") == F.col("k")), "left").where(mark | F.col("t").isNotNull())
    read = F.when(F.col("t").isNotNull(), F.slice("_w", F.col("_p") + 1, F.col("k")))
    return met.select("doc_id", "text_key", F.size("_w").cast("long").alias("n_words"), "t", "label", "exact", "size", "need", "k", (F.col("_p") - F.col("q")).alias("diagonal"), "q", "gram", read.alias("read"))


def _covered(hits: Column) -> Column:
    """How many words of a template its grams cover, each once."""
    places = F.transform(hits, lambda h: F.sequence(h["q"], h["q"] + h["k"] - 1))
    return F.size(F.array_distinct(F.flatten(places)))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Spans found in each row: doc_id, text_key, n_words, spans array of (label, exact, first, last, agree), sorted.

    first and last: the places of a span's first and last word in the text, from
    0; agree: share of the template's words that stand in a run of a gram or
    more in place, each counted once. Bands of diagonals are twice as wide as
    their template is long and begin at every length of it, so wherever words
    are put in or left out, a template stays whole in a band as long as the text
    has no more foreign words between its parts than the template has words. Bands
    next to one another that hold a template are one span, with the best agree of
    them; a phrase is a span at each of its places. Diagonals in a tie need no
    order, as all of a band count. A row without spans has an empty array; null
    or empty text has no words; an empty table gives no rows. Repeated rows each
    get a row. The templates are parameters written out in code, so they are
    broadcast; texts are never shuffled, only the words of grams that voted,
    however long a text is, and what is gathered for a band is bounded by its
    template.
    """
    hits = _hits(docs, templates(docs.sparkSession, phrases, notices), id_col, text_col)
    # A gram stands once on a diagonal, so there are no more hits than the template has words (copies of a row: the same ones again).
    hit = F.when(F.col("t").isNotNull(), F.struct("q", "k", "gram", "read", (F.col("diagonal") + F.col("q")).alias("p")))
    row = ("doc_id", "text_key", "n_words")
    keys = (*row, "t", "label", "exact", "size", "need")
    by_diagonal = hits.groupBy(*keys, "diagonal").agg(F.collect_set(hit).alias("hits"), F.sum(F.when(F.col("t").isNull(), 1)).alias("copies"))
    band = F.floor(F.col("diagonal") / F.col("size")).cast("int")
    bands = F.when(F.col("exact"), F.array("diagonal")).otherwise(F.array(band, band - 1))
    merged = by_diagonal.withColumn("band", F.explode(F.when(F.col("t").isNull(), F.array(F.lit(0))).otherwise(bands)))
    merged = merged.groupBy(*keys, "band").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.max("copies").alias("copies"))
    # Votes decide which bands are looked at; then words are compared, hashes having been equal.
    elected = merged.where(F.col("t").isNull() | (F.size("hits") >= F.col("need"))).withColumn("hits", F.filter("hits", lambda h: h["gram"] == h["read"]))
    share = _covered(F.col("hits")) / F.col("size")
    at = F.array_min(F.transform("hits", lambda h: h["p"])), F.array_max(F.transform("hits", lambda h: h["p"] + h["k"] - 1))
    held = elected.select(*keys, "band", "copies", at[0].cast("long").alias("first"), at[1].cast("long").alias("last"), F.round(share, 4).alias("agree"), F.when(F.col("exact"), share == 1).otherwise(share >= AGREE).alias("_held"))
    held = held.where(F.col("t").isNull() | F.col("_held"))
    order = Window.partitionBy(*row, "t").orderBy("band")
    new = F.when(F.col("exact") | (F.col("band") - F.coalesce(F.lag("band").over(order), F.col("band") - 2) > 1), 1).otherwise(0)
    spans = held.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order)).groupBy(*keys, "_n")
    spans = spans.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("agree").alias("agree"), F.max("copies").alias("copies"))
    span = F.struct("label", "exact", "first", "last", "agree")
    out = spans.groupBy(*row).agg(F.max("copies").alias("_copies"), F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), span))).alias("spans"))
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")
