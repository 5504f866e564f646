"""Licence scans by canonical digest lookup.

A text is made canonical: lower-cased, equivalent spellings replaced, lines that only
state a copyright taken out, and everything but letters and digits turned into single
blanks.  The SHA-256 of the whole canonical text is joined with the digests of known
licences.  The unit is the whole text, or with ``lines=True`` every line too, for notices
that stand on a line of their own.  All steps are built-in functions.

Nulls: a null text has no licence, nor has one whose canonical form is empty.  Repeated
rows give one row each.  Of several known names for one canonical text the first in code
point order is given.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden

# Spellings that count as equal, each with the form that stands for it.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("whilst", "while"),
    ("gnu general public license gpl", "gnu general public license"),
    ("gnu gpl", "gnu general public license"),
    ("version 2 0", "version 2"),
    ("v2 0", "version 2"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("https", "http"),
)

# Texts and notices of well-known licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = _BSD_HEAD + _BSD_NAMES + _BSD_TAIL
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
KNOWN = (
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3),
    ("0BSD", ZERO_BSD),
    ("Unlicense", UNLICENSE),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

# Words after "copyright" in the running text of licences, where no holder is named.
NOT_HOLDERS = ("notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "statement", "statements", "license", "licenses", "licence", "licences", "interest", "interests", "protection", "and", "or", "in", "is", "to", "as", "are")

#: A line that states a copyright, and nothing else: a sign, or the word and then a year or a holder.
COPYRIGHT_LINE = (
    r"(?md)^[^\p{L}\p{N}\n]*(?:\(c\)|©|all rights reserved|(?:portions )?copyrights?[^\p{L}\p{N}\n]+(?!(?:"
    + "|".join(NOT_HOLDERS)
    + r")(?![\p{L}\p{N}]))[\p{L}\p{N}])[^\n]*$"
)


def canonical(text: Column) -> Column:
    """The canonical form of a text, '' for a null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    t = F.regexp_replace(t, " +", " ")
    for written, meant in SPELLINGS:
        t = F.replace(t, F.lit(f" {written} "), F.lit(f" {meant} "))
    return F.trim(t)


def registry(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, canonical, digest) of known licence texts."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in row)) for row in known)
    return prepared(spark.sql(f"select * from values {quoted} as t(license_id, text)"))


def prepared(known: DataFrame) -> DataFrame:
    """Known licences (license_id, text) as a registry: one name for each canonical text."""
    c = known.select("license_id", canonical(F.col("text")).alias("canonical")).where("canonical <> ''")
    return c.groupBy("canonical").agg(F.min("license_id").alias("license_id")).withColumn("digest", F.sha2("canonical", 256))


def scan(docs: DataFrame, known: DataFrame, text: str = "text", lines: bool = True) -> DataFrame:
    """``docs`` with ``digest``, ``license_id`` (of the whole text, or null) and ``line_licenses``.

    ``known`` comes from ``registry`` or ``prepared``.  ``digest`` is the SHA-256 of the
    canonical whole text.  ``line_licenses`` is the sorted array of licences that a line of
    the text states as a whole; empty without ``lines``.  Columns of ``docs`` with the
    names of results are replaced.
    """
    raw, at = hidden(docs, "_raw"), hidden(docs, "_lines")
    keep = [col(c) for c in docs.columns if c.lower() not in ("digest", "license_id", "line_licenses")]
    names = known.select("digest", "license_id")
    # lines follow from the text alone: their licences are found by text and joined back
    rows = docs.select(*keep, F.sha2(F.coalesce(col(text), F.lit("")), 256).alias(raw), F.sha2(canonical(col(text)), 256).alias("digest"))
    rows = rows.join(names, "digest", "left")
    if not lines:
        return rows.select(*keep, "digest", "license_id", F.array().cast("array<string>").alias("line_licenses"))
    parts = docs.select(F.sha2(col(text), 256).alias(raw), F.explode(F.split(col(text), r"\r\n|[\r\n]")).alias("line"))
    parts = parts.where(F.trim("line") != "").withColumn("digest", F.sha2(canonical(F.col("line")), 256))
    stated = parts.join(names, "digest").groupBy(raw).agg(F.array_sort(F.collect_set("license_id")).alias(at))
    out = rows.join(stated, raw, "left")
    return out.select(*keep, "digest", "license_id", F.coalesce(at, F.array().cast("array<string>")).alias("line_licenses"))
