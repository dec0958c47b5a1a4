"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, read, stash, text_or_empty

THRESHOLD = 0.6
SURE = 0.9  # cosine of a title, and of a passage that is less than half of a licence file
BROADCAST_ROWS = 200_000
MAX_TEMPLATE_WORDS = 20_000  # distinct words of all templates
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"

BLOCKS = (1, 2, 3, 5, 8, 12, 20, 32)  # lines of a block
BACK = (0, 2)  # lines that a block starts before a line with a word of a template
WHOLE, TITLE = -1, -2  # units of a licence file: its whole text, and its first one or two lines with words

# Short forms, headers and texts of public licences.
_WARRANTY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_GNU = "is free software{0}: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program " + _GNU.format("", "", "3")),
    ("GPL-3.0", "This program " + _GNU.format("", "", "3") + " " + _NO_WARRANTY + " See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program " + _GNU.format("", "", "2") + " " + _NO_WARRANTY + " See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-2.1", "This library " + _GNU.format("", "Lesser", "2.1") + " " + _NO_WARRANTY.replace("program", "library") + " See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This library " + _GNU.format("", "Lesser", "3") + " " + _NO_WARRANTY.replace("program", "library") + " See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program " + _GNU.format("", "Affero", "3") + " " + _NO_WARRANTY + " See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS} {_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS} {_WARRANTY}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
]
# The titles of public licences.
TITLES = [
    ("AFL-3.0", 'Academic Free License ("AFL") v. 3.0'),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Artistic-1.0", 'The "Artistic License"'),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
]


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None, titles: list[tuple[str, str]] | None = None) -> DataFrame:
    """(template, license, title, words) of each template; fixed values unless rows or titles are given."""
    rows, titles = TEMPLATES if rows is None else rows, TITLES if titles is None else titles
    both = [(name, text, False) for name, text in rows] + [(name, text, True) for name, text in titles]
    items = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(title).alias("title"), F.lit(text).alias("text")) for i, (name, text, title) in enumerate(both)])
    return spark.range(1).select(F.inline(items)).select("template", "license", "title", words(F.col("text")).alias("words"))


def lines_of(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """(file_no, is_file, lines): the words of every line of each file, and whether it is named as licence files are."""
    base = F.coalesce(F.element_at(F.split(path_col, "/"), -1), F.lit(""))
    return files.select(id_col, base.rlike(LICENCE_FILE).alias("is_file"), F.transform(F.split(text_or_empty(text_col), "\n"), words).alias("lines"))


def units_near(lines: DataFrame, needed: list[str], id_col: str) -> DataFrame:
    """(file_no, unit, sure, words): blocks of BLOCKS lines around the lines with a needed word, each known by its first
    line, and of a licence file the whole text and its title. sure: a block that is less than half of a licence file,
    or a title, either of which has to match at SURE."""
    own = F.array(*map(F.lit, needed)).cast("array<string>")
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.arrays_overlap(x, own), i)), lambda i: i.isNotNull())
    found = lines.select(id_col, "is_file", "lines", at.alias("at")).where(F.size("at") > 0)
    all_words = F.when(F.col("is_file"), F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x)))
    first = F.explode(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(*[F.greatest(i - b, F.lit(0)) for b in BACK]))))).alias("unit")
    blocks = found.select(id_col, "lines", all_words.alias("all"), first).select(id_col, "lines", "all", "unit", F.explode(F.array(*map(F.lit, BLOCKS))).alias("size"))
    blocks = blocks.where((F.col("size") == 1) | (F.col("unit") + F.col("size") <= F.size("lines")))
    blocks = blocks.select(id_col, "unit", "all", F.flatten(F.slice("lines", F.col("unit") + 1, F.col("size"))).alias("words"))
    blocks = blocks.select(id_col, "unit", F.coalesce(F.size("words") * 2 < F.col("all"), F.lit(False)).alias("sure"), "words")
    whole = found.where("is_file").select(id_col, F.lit(WHOLE).alias("unit"), F.lit(False).alias("sure"), F.flatten("lines").alias("words"))
    named = lines.where("is_file").select(id_col, F.filter("lines", lambda x: F.size(x) > 0).alias("lines"))
    title = named.select(id_col, F.explode(F.array(F.lit(1), F.lit(2))).alias("size"), "lines").select(id_col, F.lit(TITLE).alias("unit"), F.lit(True).alias("sure"), F.flatten(F.slice("lines", F.lit(1), F.col("size"))).alias("words"))
    return blocks.unionByName(whole).where(F.arrays_overlap("words", own)).unionByName(title.where(F.size("words") > 0))


def template_weights(texts: DataFrame, known: DataFrame) -> tuple[DataFrame, list[str], float]:
    """(weights(template, license, title, word, idf, weight), the words of which a match must have one, idf of an unknown word).

    idf counts the lines of all files. A template's words are taken from the
    rarest on until the others together weigh less than the threshold: by the
    Cauchy-Schwarz inequality a block without any of the words taken can't
    reach it. Titles are compared with titles alone, so they ask for no words.
    """
    spark = known.sparkSession
    vocabulary = [r[0] for r in known.select(F.explode("words")).distinct().sort("col").limit(MAX_TEMPLATE_WORDS + 1).collect()]
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    has = F.array_intersect("words", F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    lines = texts.select(F.explode("lines").alias("words")).where(F.size("words") > 0)
    counted = {r["word"]: r["n"] for r in lines.select(F.explode(F.concat(has, F.array(F.lit("\n")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = counted.get("\n", 0)
    idf = {w: math.log((n + 1) / (counted.get(w, 0) + 1)) + 1 for w in vocabulary}
    tf = known.select("template", "license", "title", F.explode("words").alias("word")).groupBy("template", "license", "title", "word").agg(F.count("*").alias("tf"))
    rows = [r.asDict() | {"idf": idf[r["word"]], "w": r["tf"] * idf[r["word"]]} for r in tf.collect()]
    rows.sort(key=lambda r: (r["template"], -r["idf"], r["word"]))
    norms: dict[int, float] = {}
    for r in rows:
        norms[r["template"]] = norms.get(r["template"], 0.0) + r["w"] ** 2
    needed, left = set(), dict(norms)
    for r in rows:
        if not r["title"] and left[r["template"]] >= (THRESHOLD - 1e-9) ** 2 * norms[r["template"]]:
            needed.add(r["word"])
        left[r["template"]] -= r["w"] ** 2
    weights = [F.struct(F.lit(r["template"]).alias("template"), F.lit(r["license"]).alias("license"), F.lit(r["title"]).alias("title"), F.lit(r["word"]).alias("word"), F.lit(r["idf"]).alias("idf"), F.lit(r["w"] / norms[r["template"]] ** 0.5).alias("weight")) for r in rows]
    table = spark.range(1).select(F.inline(F.array(*weights)))
    return table, sorted(needed), math.log(n + 1) + 1


def best_matches(texts: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """(id, license, score, unit): the best template of each file at cosine THRESHOLD or more, SURE where units_near says so.

    The title of a licence file goes before anything in it. Ties go to the
    license that sorts first, then the earliest line.
    """
    weights, needed, unknown = template_weights(texts, known)
    near = stash(units_near(texts, needed, id_col).withColumn("u", F.monotonically_increasing_id()), "license-blocks")
    tf = near.select("u", F.explode("words").alias("word")).groupBy("u", "word").agg(F.count("*").alias("tf"))
    idf = weights.select("word", "idf").distinct()
    tf = tf.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    tf = stash(tf.select("u", "word", "w"), "license-words")
    norm = tf.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights.select("template", "license", "title", "word", "weight")), "word").groupBy("u", "template", "license", "title").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, "u").select("u", "license", "title", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= THRESHOLD)
    found = near.select("u", id_col, "unit", "sure").join(scored, "u")
    found = found.where((F.col("title") == (F.col("unit") == TITLE)) & (~F.col("sure") | (F.col("score") >= SURE)))
    best = F.struct((~F.col("title")).alias("inside"), (-F.col("score")).alias("minus"), "license", "unit")
    return found.groupBy(id_col).agg(F.min(best).alias("best")).select(id_col, F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"), F.col("best.unit").alias("unit"))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the nearest to the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per file: id, path, license, score, how (header, file, inherited, none), from_dir.

    Every line of the whole text counts as a header, and so do the blocks of
    BLOCKS lines around a line with a telling word of a template, so that a
    wrapped header is seen whole. In a file named as licence files are the
    whole text counts too, a passage of less than half of it only at SURE, and
    before either the title in its first lines. A file without a match of its own takes
    the license of the nearest directory above it that holds a licence file
    with a match; of several the best score, then the license that sorts
    first. Words are runs of ASCII letters, digits and other characters above
    U+007F; a word that no template has weighs like one that no line has. A
    null text is empty, a null path lies in no directory. Rows with the same id
    share what either matches. Ids join as they are, a null id has no match.
    """
    spark = files.sparkSession
    known = templates(spark) if known is None else known
    files = files.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), F.col(text_col).cast("string").alias("_text"))
    own = stash(best_matches(lines_of(files, "_id", "_path", "_text"), known, "_id"), "license-matches")
    named = files.select("_id", "_path").join(own, "_id", "left")
    base = F.element_at(F.split("_path", "/"), -1)
    ranked = F.struct((-F.col("score")).alias("minus"), "license")
    in_dir = named.where(F.col("license").isNotNull() & base.rlike(LICENCE_FILE)).groupBy(F.get(ancestors(F.col("_path")), F.lit(0)).alias("dir")).agg(F.min(ranked).alias("of_dir"))
    in_dir = stash(in_dir, "directory-licenses")
    bare = named.where("license is null and _path is not null").select("_path").distinct()
    above = bare.select("_path", F.posexplode(ancestors(F.col("_path"))).alias("up", "dir")).join(broadcast_if(in_dir, in_dir.count(), BROADCAST_ROWS), "dir")
    nearest = above.groupBy("_path").agg(F.min_by(F.struct("dir", "of_dir"), "up").alias("from"))
    out = named.join(nearest, "_path", "left")
    use = F.col("license").isNull() & F.col("from").isNotNull()
    how = F.when(F.col("unit") >= 0, "header").when(F.col("unit") < 0, "file").when(use, "inherited").otherwise("none")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias("path"),
        F.when(use, F.col("from.of_dir.license")).otherwise(F.col("license")).alias("license"),
        F.when(use, -F.col("from.of_dir.minus")).otherwise(F.col("score")).alias("score"),
        how.alias("how"),
        F.when(use, F.col("from.dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Lays the documents out as a tree: 64 to a directory of their source, the first of each as its licence file,
    and that of every 64th directory as the source's own."""
    block = F.floor(F.col("doc_id") / 64).cast("string")
    name = F.when(F.col("doc_id") % 4096 == 0, F.lit("LICENSE")).when(F.col("doc_id") % 64 == 0, F.concat(block, F.lit("/LICENSE"))).otherwise(F.concat(block, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), name).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses over documents, laid out as files of a tree."""
    return scan_licenses(document_paths(read(spark, sf_dir, "documents")))
