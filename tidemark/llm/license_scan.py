"""Licence scan by canonical digests.

Every text, and every line of it, is brought to a canonical form: lower case, copyright lines
dropped, punctuation and white space to single spaces, equivalent spellings replaced.  Its
SHA-256 is joined with the digests of known licence texts and notices, which pass through the
same expression.  The known table is fixed in size, so the join broadcasts it and no text is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

# Spellings that mean the same, applied in this order to the padded form.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("no derivatives", "noderivatives"), ("share alike", "sharealike"), ("per cent", "percent"),
    ("v 2", "version 2"), ("v2", "version 2"), ("v 3", "version 3"), ("v3", "version 3"),
    ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("merchantibility", "merchantability"),
    ("creative commons", "cc"), ("attribution noncommercial", "by nc"), ("cc attribution", "cc by"),
)
# Licence names in canonical form, with identifier and family.
NAMES = (
    ("MIT", "permissive", ("mit license", "mit")),
    ("Apache-2.0", "permissive", ("apache license version 2", "apache license 2 0", "apache 2 0")),
    ("BSD-2-Clause", "permissive", ("bsd 2 clause license", "simplified bsd license")),
    ("BSD-3-Clause", "permissive", ("bsd 3 clause license", "new bsd license", "bsd license")),
    ("ISC", "permissive", ("isc license",)),
    ("Zlib", "permissive", ("zlib license",)),
    ("GPL-2.0", "copyleft", ("gnu general public license version 2", "gnu gpl version 2", "gpl version 2")),
    ("GPL-3.0", "copyleft", ("gnu general public license version 3", "gnu gpl version 3", "gpl version 3")),
    ("LGPL-3.0", "copyleft", ("gnu lesser general public license version 3", "lgpl version 3")),
    ("AGPL-3.0", "copyleft", ("gnu affero general public license version 3", "agpl version 3")),
    ("MPL-2.0", "copyleft", ("mozilla public license version 2",)),
    ("CC0-1.0", "public-domain", ("cc0 1 0", "cc0")),
    ("CC-BY-4.0", "attribution", ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc by sa 4 0",)),
    ("CC-BY-ND-4.0", "restricted", ("cc by nd 4 0",)),
    ("CC-BY-NC-4.0", "restricted", ("cc by nc 4 0",)),
    ("CC-BY-NC-SA-4.0", "restricted", ("cc by nc sa 4 0",)),
    ("CC-BY-NC-ND-4.0", "restricted", ("cc by nc nd 4 0",)),
)
SUBJECTS = ("", "this work is ", "this software is ", "this file is ", "this text is ", "code ", "content ")
VERBS = ("licensed under", "released under", "distributed under", "available under", "published under")
# Whole licence texts.
TEXTS = (
    ("MIT", "permissive", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Zlib", "permissive", """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
)
# Digests of the canonical forms of whole texts, with and without their appendix.
DIGESTS = (
    ("Apache-2.0", "permissive", "13cd6c993e1e89d29c4ef14d1970035e8449fec358420472ef160e0eeafd4e41"),
    ("Apache-2.0", "permissive", "6e5156b87da1d881c8a1d56d56de5c68d93225e66ba369f34f48896e525d5b6c"),
    ("Apache-2.0", "permissive", "9d754c7de3e34d52666ad6d24edf8823aad93f91ba009a64493fccb4696f0df0"),
    ("Apache-2.0", "permissive", "c849e5a260736a753fd33e4db1341c99ce43e2a53fa0fb3b5b9d2f558cfce56e"),
    ("Apache-2.0", "permissive", "e0b640e5255156791fa16805ec3d3a6bd85bb30e43c8c48ed5d67231df75c85e"),
    ("Apache-2.0", "permissive", "e13391f0ba6f2a26145a81d48d81eecd21fb3999bebf369b8eda217751375cc2"),
    ("BSD-2-Clause", "permissive", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "permissive", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "permissive", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "permissive", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("CC0-1.0", "public-domain", "bcf1ca6bfc638eb154167518097e0e35e99b24f6b9bb4b2a6cb9b919bfda843a"),
    ("GPL-2.0", "copyleft", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "copyleft", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", "copyleft", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", "copyleft", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("GPL-3.0", "copyleft", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("GPL-3.0", "copyleft", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    ("GPL-3.0", "copyleft", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("LGPL-3.0", "copyleft", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "copyleft", "08978d4dbcdf8773027f972cfd1aba21fe94904fc0194fcf2cf58ee987701793"),
    ("MPL-2.0", "copyleft", "8c426530c964aaf311bfbb5e5704430287658bcfea3fd0c5eec2610fa065565a"),
)
# Standard headers, whole; the one of the GNU licences by name and version.
_GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as
published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_GNU_END = ("", """ You should have received a copy of the GNU {0} along with this program. If not, see
<https://www.gnu.org/licenses/>.""", """ You should have received a copy of the GNU {0} along with this program. If not,
see <http://www.gnu.org/licenses/>.""")
HEADERS = tuple((lic, "copyleft", (_GNU + end).format(name, version)) for lic, name, version in (
    ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
    ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
    for end in _GNU_END) + (
    ("MPL-2.0", "copyleft", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "copyleft", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public"),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License");'),
) + tuple(("Apache-2.0", "permissive", f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
{scheme}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""") for scheme in ("http", "https"))
TITLES = {"MIT": ("", "MIT License\n"), "ISC": ("", "ISC License\n"), "Zlib": ("", "zlib License\n")}

_COPYRIGHT = (r"^[\s\p{Punct}]*(copyright\b|\(c\)\s*\d{4}|©|all rights reserved[\s\p{Punct}]*$).*")


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; a copyright line gives the empty string."""
    low = F.lower(line)
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in EQUIVALENT:
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    plain = F.regexp_replace(F.trim(words), " +", " ")
    return F.when(low.rlike(_COPYRIGHT), F.lit("")).otherwise(plain)


def canonical_units(text: Column) -> Column:
    """Array of (unit, form): the whole text first, then each line that is not empty."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), canonical_line), lambda x: x != "")
    def unit(name: str, form: Column) -> Column:
        return F.struct(F.lit(name).alias("unit"), F.sha2(form, 256).alias("digest"))
    return F.concat(F.array(unit("text", F.array_join(lines, " "))), F.transform(lines, lambda x: unit("line", x)))


def known_licenses(spark: SparkSession) -> DataFrame:
    """Digest table (license, family, digest): a few hundred rows, fixed by the lists above."""
    raw = [(lic, family, f"{subject}{verb} {the}{name}") for lic, family, names in NAMES for name in names
           for subject in SUBJECTS for verb in VERBS for the in ("", "the ", "a ")]
    raw += [(lic, family, f"spdx license identifier {lic}") for lic, family, _ in NAMES]
    raw += [(lic, family, title + text) for lic, family, text in TEXTS for title in TITLES[lic]]
    raw += HEADERS
    frame = spark.createDataFrame(raw, "license string, family string, text string")
    whole = canonical_units(F.col("text"))[0]["digest"]
    fixed = spark.createDataFrame(list(DIGESTS), "license string, family string, digest string")
    return frame.select("license", "family", whole.alias("digest")).unionByName(fixed).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Known licences of every document.

    Returns one row per input row: the id column, ``licenses`` (sorted, distinct identifiers
    found in the whole text or its lines; empty if none), ``families``, ``unit`` (``text`` if
    the whole text is a known one, ``line`` if only lines are, else null) and ``digest`` (of the
    whole text's canonical form).  Null and empty texts match nothing; repeated rows are each
    scanned; other columns are never read.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    text = text_or_empty(text_col)
    row = "_row"
    units = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias(row),
                        canonical_units(text).alias("_units"))
    each = units.select("_id", row, F.col("_units")[0]["digest"].alias("digest"),
                        F.posexplode("_units").alias("_at", "_u"))
    hits = each.join(F.broadcast(known.withColumnRenamed("digest", "_known")),
                     F.col("_u.digest") == F.col("_known"), "left")
    kept = hits.where(F.col("license").isNotNull() | (F.col("_at") == 0))
    return (kept.groupBy(row, "_id", "digest")
            .agg(F.sort_array(F.collect_set("license")).alias("licenses"),
                 F.sort_array(F.collect_set("family")).alias("families"),
                 F.max(F.when(F.col("license").isNotNull(), F.col("_u.unit"))).alias("unit"))
            .select(F.col("_id").alias(id_col), "licenses", "families", "unit", "digest"))
