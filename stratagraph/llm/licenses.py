"""License scan by canonical digest, with DataFrame functions only.

A text is put in canonical form: copyright lines dropped, A-Z lower-cased,
equivalent spellings replaced, every run of punctuation and white space one
space. The SHA-256 of the whole canonical text is hash-joined to the digests of known
licenses. Lines that name a license are looked up in the same way among known notices.
Callers may add texts of their own (``more``: kind, license_id, text).

A copyright line names an owner or a year ("Copyright (c) 2020 X", "Portions Copyright (c) X", "Copyright Jane Doe", "(c) 1999 X", "© X") or is the bare word; lines of a
license that only begin with the word ("copyright notice ...", "COPYRIGHT HOLDERS ...", item "(c) You must ...") stay, so that wrapping doesn't matter.

Nulls: a null text has no digest, no license and no notice; an empty text (or
one of copyright lines only) has the digest of the empty string and no license. Repeated rows are
each returned, an empty table gives no rows, long texts are digested whole. A new name that clashes with a kept column gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

# fixed values: texts of licenses and notices, by identifier
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_2 = f"{_BSD_HEAD}\n{_BSD_TAIL}"
BSD_3 = f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}"
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
LICENSES = {"MIT": MIT, "ISC": ISC, "0BSD": ZERO_BSD, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Zlib": ZLIB, "Unlicense": UNLICENSE, "BSL-1.0": BSL, "Apache-2.0": APACHE_HEADER}
# fixed values: digests of the canonical forms of long licenses' published texts
DIGESTS = {
    "Apache-2.0": ["4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.3": ["7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"],
    "GPL-1.0": ["8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"],
    "GPL-2.0": ["efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"],
    "MPL-2.0": ["4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"],
}
# fixed values: titles, the first line of a license, and names that notices use
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL, version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
# fixed values: identifiers of which SPDX lines are known without a text or title here
SPDX_IDS = ["GPL-1.0", "LGPL-2.0", "GFDL-1.3", "MPL-1.1", "MIT-0", "BSD-4-Clause", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "Artistic-2.0", "CC-BY-3.0", "CC-BY-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "OFL-1.1", "PSF-2.0", "PostgreSQL", "NCSA", "X11", "WTFPL", "BlueOak-1.0.0", "MS-PL"]
SPDX_IDS += [f"{k}-{x}" for k in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.3") for x in ("only", "or-later")]
#: How a line names a license.
WORDINGS = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}.", "This file is licensed under the {}.", "Distributed under the {}.", "License: {}"]


def notices_of(license_id: str) -> list[str]:
    """Lines that name the license."""
    lines = [w.format(t) for t in [*TITLES[license_id], license_id] for w in WORDINGS] + [f"SPDX-License-Identifier: {license_id}"]
    if license_id == "Apache-2.0":
        lines.append('Licensed under the Apache License, Version 2.0 (the "License");')
    return lines


#: Equivalent spellings, replaced in this order in lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("redistribution s", "redistributions"), ("http://", "https://"), ("&", " and ")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARGIN = r"^[ \t*#/;%!>-]*"
#: Lines that name an owner or a year, and lines that look so but belong to a license.
COPYRIGHT_LINE = _MARGIN + r"(?i:portions[ \t]+)?(?:(?i:copyright)[ \t]*(?:(?i:\(c\)|&copy;|by[ \t])|©|:|[0-9]{4})|(?i:\(c\)|&copy;)[ \t]*(?:(?i:copyright)|[0-9]{4})|©|Copyright[ \t]+(?:[A-Z0-9<\[{(]|the[ \t])|(?:Copyright|(?i:all rights reserved))[. \t\r]*$)"
NO_COPYRIGHT_LINE = _MARGIN + r"Copyright[ \t]+(?i:licen[cs]e|notice|law|act[ ,.]|holder|owner|statement|management|interest|disclaimer|term|and |or |the above|the copyright)"
#: ASCII that is no letter or digit, and typographic quotes, dashes, dots and spaces.
FILLER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2026}]+"
NAMES_LICENSE = r"licen[cs]e"
#: An SPDX line in lower case and its expression, and what stands between the identifiers of one.
SPDX_LINE, SPDX_BETWEEN = r"spdx-license-identifier:[ \t]*([^\n]*)", r"[ \t()]+(?:or|and|with)[ \t()]+"


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(COPYRIGHT_LINE) | x.rlike(NO_COPYRIGHT_LINE))
    t = F.translate(F.array_join(lines, "\n"), UPPER, LOWER)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, FILLER, " "))


def known_texts() -> list[tuple[str, str, str]]:
    """(kind, license, text); a license counts with and without its titles, a notice also as a whole text."""
    rows = [("license", k, t) for k, t in LICENSES.items()] + [("license", k, f"{x}\n\n{t}") for k, t in LICENSES.items() for x in TITLES[k]]
    rows += [(kind, k, t) for k in TITLES for t in notices_of(k) for kind in ("license", "notice")]
    return rows + [(kind, k, t) for k in SPDX_IDS for t in (f"SPDX-License-Identifier: {k}", f"License: {k}") for kind in ("license", "notice")]


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """Digests of the known texts: kind, license_id, digest; of licenses with one digest the first counts."""
    rows = spark.createDataFrame(known_texts(), "kind string, license_id string, t string")
    if more is not None:
        rows = rows.union(more.select("kind", "license_id", F.col("text").alias("t")))
    rows = rows.select("kind", "license_id", F.sha2(canonical(F.col("t")), 256).alias("digest"))
    rows = rows.union(spark.createDataFrame([("license", k, d) for k, ds in DIGESTS.items() for d in ds], rows.schema))
    return rows.groupBy("kind", "digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, more: DataFrame | None = None) -> DataFrame:
    """Adds: digest of the canonical text, license_id (null if unknown), notices (identifiers
    named by lines of the text, sorted, comma-joined) and n_notices (such lines; an SPDX expression counts by each known identifier).

    Both look-ups are joins with a fixed table of some hundred digests (and the rows of ``more``: kind, "license" for
    whole texts or "notice" for lines, license_id, text), so the broadcast doesn't grow; no shuffle of the documents is needed.
    """
    keep = docs.columns if keep is None else keep
    k = known(docs.sparkSession, more)
    lines = F.filter(F.split(F.translate(F.col(text), UPPER, LOWER), "\n", -1), lambda x: x.rlike(NAMES_LICENSE))
    # an SPDX line counts by each identifier of its expression
    one = lambda x: F.transform(F.split(F.regexp_extract(x, SPDX_LINE, 1), SPDX_BETWEEN), lambda y: F.concat(F.lit("spdx-license-identifier: "), y))
    named = F.flatten(F.transform(lines, lambda x: F.when(x.rlike(SPDX_LINE), one(x)).otherwise(F.array(x))))
    digests = F.transform(named, lambda x: F.sha2(canonical(x), 256))
    kd, lid = fresh(docs, "sg_digest"), fresh(docs, "sg_license")
    of_text = F.broadcast(k.where("kind = 'license'").select(F.col("digest").alias(kd), F.col("license_id").alias(lid)))
    # the fixed table of notices as a literal map
    notices = F.create_map(*[F.lit(x) for r in k.where("kind = 'notice'").collect() for x in (r.digest, r.license_id)])
    dig, lin = fresh(docs, "sg_canonical"), fresh(docs, "sg_lines")
    got = docs.select(*dict.fromkeys([*keep, text])).withColumn(dig, F.sha2(canonical(F.col(text)), 256)).withColumn(lin, digests)
    got = got.join(of_text, F.col(dig) == F.col(kd), "left")
    ids = F.filter(F.transform(F.col(lin), lambda x: F.try_element_at(notices, x)), lambda x: x.isNotNull())
    kept = docs.select(*keep)  # a new name that clashes gets underscores
    new = {"digest": F.col(dig), "license_id": F.col(lid), "notices": F.coalesce(F.array_join(F.array_sort(F.array_distinct(ids)), ","), F.lit("")), "n_notices": F.coalesce(F.size(ids), F.lit(0)).cast("long")}
    return got.select(*keep, *[c.alias(fresh(kept, k)) for k, c in new.items()])


def _sql_canonical(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate(array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not regexp_matches(l, {q(COPYRIGHT_LINE)}) or regexp_matches(l, {q(NO_COPYRIGHT_LINE)})), chr(10)), '{UPPER}', '{LOWER}')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({t}, {q(FILLER)}, ' ', 'g'))"


def scan_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in known_texts())
    digests = "".join(f" union all select 'license', {q(k)}, {q(d)}" for k, ds in DIGESTS.items() for d in ds)
    return f"""
with k as (select kind, min(license_id) license_id, digest from (select kind, license_id, sha256({_sql_canonical('t')}) digest from (values {rows}) v(kind, license_id, t){digests}) group by kind, digest),
d as (select doc_id, text, sha256({_sql_canonical('text')}) digest from documents),
l as (select doc_id, unnest(string_split(translate(text, '{UPPER}', '{LOWER}'), chr(10))) line from documents),
m as (select doc_id, unnest(case when regexp_matches(line, '{SPDX_LINE}') then list_transform(string_split_regex(regexp_extract(line, '{SPDX_LINE}', 1), '{SPDX_BETWEEN}'), lambda y: 'spdx-license-identifier: ' || y) else [line] end) line
      from l where regexp_matches(line, '{NAMES_LICENSE}')),
n as (select doc_id, string_agg(distinct license_id, ',' order by license_id) notices, count(*) n
      from (select doc_id, sha256({_sql_canonical('line')}) digest from m) join k using (digest) where kind = 'notice' group by doc_id)
select d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') notices, coalesce(n.n, 0) n_notices
from d left join k on k.digest = d.digest and k.kind = 'license' left join n on n.doc_id = d.doc_id"""
