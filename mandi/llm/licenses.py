"""Operator 8: license scans by canonical digest, native.

A text's canonical form is lower case, with copyright lines, titles and reservations dropped, equivalent
spellings made one, and punctuation and white space squeezed to single spaces.  The canonical forms of
whole texts, of their paragraphs (lines up to an empty or dropped one) and of their single lines are
hashed and hash-joined with the digests of known licences: whole texts, notices, and the files in the
folder licences, by name.  A text holds a licence as a block if it has every paragraph of it.  Known
digests are a fixed list, so they are broadcast; documents aren't shuffled but for one small row each
and its hits.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices by id.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "0BSD": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}
COPYRIGHT = r"^\s*(copyright|\(c\)|©)\s*(\(c\)|©|[0-9]|\[|<)|^\s*(\(c\)|©)"
# Canonical paragraphs that only name a licence, or reserve rights.
DROPPED = ["mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "bsd 2 clause license", "bsd 3 clause license", "bsd zero clause license", "simplified bsd license", "new bsd license", "all rights reserved"]
# Spellings that mean the same, after punctuation is gone.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement", "per cent": "percent", "acknowledgement": "acknowledgment", "favour": "favor", "merchantibility": "merchantability"}


def canonical_line(line: Column) -> Column:
    """One line's canonical form; empty for a copyright line or one without a letter or digit."""
    low = F.lower(line)
    text = F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(text))


def known_texts(folder: Path = Path(__file__).parent / "licences") -> list[tuple[str, str]]:
    """License id and text: those of KNOWN, and the files of a folder, named by id."""
    return [(k, t) for k, ts in KNOWN.items() for t in ts] + [(f.stem, f.read_text("utf-8")) for f in sorted(folder.glob("*.txt"))]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, whole_id (the licence whose whole text it is of, the first by id) and blocks: (number, license_id, paragraphs) of the texts with it as a paragraph."""
    texts = known_texts() if known is None else known
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "number int, license_id string, text string").withColumn("lines", _lines(F.col("text")))
    parts = df.withColumn("parts", F.array_distinct(_paragraphs(F.col("lines"))))
    whole = df.groupBy(F.md5(_whole(F.col("lines"))).alias("digest")).agg(F.min("license_id").alias("whole_id"))
    blocks = parts.select("number", "license_id", F.size("parts").alias("paragraphs"), F.explode("parts").alias("part")).groupBy(F.md5("part").alias("digest")).agg(F.collect_list(F.struct("number", "license_id", "paragraphs")).alias("blocks"))
    return whole.join(blocks, "digest", "full")


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), canonical_line)


def _paragraphs(lines: Column) -> Column:
    """Lines joined up to an empty one, but for titles and reservations."""
    joined = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+", -1), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))))
    return F.filter(joined, lambda x: (x != "") & ~x.isin(DROPPED))


def _whole(lines: Column) -> Column:
    return F.array_join(_paragraphs(lines), " ")


MOST_DIGESTS = 200_000  # of a caller's licences, in a broadcast


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, text_license, n_license_lines, line_licenses, block_licenses of each row of docs (doc_id, text).

    text_digest: md5 of the whole text's canonical form; text_license: the known licence with that
    digest, or null; line_licenses: ids whose whole digest a line has, sorted and comma-joined, each once;
    n_license_lines: such lines; block_licenses: ids of known texts whose every paragraph is one of the
    text's, likewise.  known: (license id, text) pairs in place of known_texts().  Null or empty text: the
    digest of an empty text, no licence.  Null doc_id and repeated rows are rows of their own.  Very long texts are read
    whole.  Ties (texts of two licences with one digest): the id that sorts first.  Empty table: empty result.
    """
    digests = known_digests(docs.sparkSession, known)
    digests = F.broadcast(digests) if known is None or digests.limit(MOST_DIGESTS + 1).count() <= MOST_DIGESTS else digests  # our own are a few thousand rows
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), _lines(F.col("text")).alias("lines"))
    kind = lambda name, texts: F.transform(texts, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("text")))
    texts = F.concat(kind("whole", F.array(_whole(F.col("lines")))), kind("line", F.filter("lines", lambda x: x != "")), kind("block", F.array_distinct(_paragraphs(F.col("lines")))))
    each = rows.select("row_id", "doc_id", F.explode(texts).alias("t")).select("row_id", "doc_id", "t.kind", F.md5("t.text").alias("digest")).join(digests, "digest", "left")
    # what isn't known stays where it was read
    hits = each.filter((F.col("kind") == "whole") | ((F.col("kind") == "line") & F.col("whole_id").isNotNull()) | ((F.col("kind") == "block") & F.col("blocks").isNotNull()))
    line, whole = F.col("kind") == "line", F.col("kind") == "whole"
    out = hits.groupBy("row_id", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("whole_id"))).alias("text_license"),
        F.count_if(line).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("whole_id")))), ",").alias("line_licenses"),
        F.flatten(F.collect_list(F.when(F.col("kind") == "block", F.col("blocks")))).alias("found"),
    )
    full = F.filter(F.array_distinct("found"), lambda b: F.size(F.filter("found", lambda x: x["number"] == b["number"])) == b["paragraphs"])
    return out.withColumn("block_licenses", F.array_join(F.array_sort(F.array_distinct(F.transform(full, lambda b: b["license_id"]))), ",")).drop("row_id", "found")


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    canon = r"regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')"
    for a, b in SPELLINGS.items():
        canon = f"replace({canon}, {quote(a)}, {quote(b)})"
    canon = f"CASE WHEN regexp_matches(lower(x), {quote(COPYRIGHT)}) THEN '' ELSE trim({canon}) END"
    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canon})"
    each = r"list_filter(list_transform(string_split_regex(array_to_string(l, chr(10)), '\n\n+'), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '' AND x NOT IN (" + ", ".join(map(quote, DROPPED)) + "))"
    whole, parts = f"array_to_string({each}, ' ')", f"list_distinct({each})"
    known = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, t) in enumerate(known_texts()))
    return f"""
WITH v AS (SELECT number, license_id, {lines} AS l FROM (VALUES {known}) v(number, license_id, text)),
k AS (SELECT min(license_id) AS license_id, md5({whole}) AS digest FROM v GROUP BY 2),
kp AS (SELECT number, license_id, len({parts}) AS n, unnest({parts}) AS part FROM v),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS l FROM documents),
e AS (SELECT r, unnest(list_filter(l, lambda x: x <> '')) AS line FROM d),
m AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM e JOIN k ON k.digest = md5(line) GROUP BY r),
p AS (SELECT r, unnest({parts}) AS part FROM d),
q AS (SELECT r, number, any_value(license_id) AS license_id FROM p JOIN kp USING (part) GROUP BY r, number HAVING count(*) = any_value(n)),
b AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS blocks FROM q GROUP BY r)
SELECT doc_id, md5({whole}) AS text_digest, k.license_id AS text_license, coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_licenses, coalesce(blocks, '') AS block_licenses
FROM d LEFT JOIN k ON k.digest = md5({whole}) LEFT JOIN m USING (r) LEFT JOIN b USING (r)
"""
