r"""License scan: canonical digests of entire texts, hash-joined to the digests of known licences.

Canonical form: lower case; list marks and copyright lines go (with a sign, a year or a blank to fill
in, or a bare `Copyright <name>` that is a paragraph of its own); what is neither an ASCII letter or digit nor beyond ASCII
becomes one space, so line ends and bullets don't matter; then spellings that mean the same are made one, also where a line
end has cut them. The known table has a fixed number of rows (KNOWN texts, DIGESTS of long texts), so it is broadcast. Beside the
whole text, each line is looked up by its own digest (one-line notices).

Nulls: a null text counts as empty; an empty canonical form matches nothing; a null doc_id is kept. Repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal in the words of a text (a single space between any two), replaced in this order.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("wilful", "willful"),
    ("https ", "http "),
]
#: The number or letter of a list item, at the start of a line or, in text that was wrapped anew, after the end of another item.
LIST_MARK = r"(?dm)(^[ \t]*|[.:;,][ \t\n]+|\b(?:and|or)[ \t\n]+)\(?([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][ \t\n]+"
#: Lines that are a notice: with a sign, a year or a blank to fill in, not text that only begins with the word, as wrapped
#: licences do. d: only line feeds end lines.
COPYRIGHT_LINE = r"(?dm)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(c\)|©|[0-9]{4}|[\[<{])|\(c\)[^a-z0-9\n]*[0-9]{4}|©|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
#: A paragraph of short lines that begin with the word: names without a year.
BARE_NOTICE = r"(?d)(\A\s*|\n[ \t]*\n)([ \t]*copyright[ \t]+[^\n]{1,60}(?:\n|\z))+([ \t]*\n|\s*\z)"
OUTSIDE = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Texts of public licences and their customary one-line notices.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n"
) + _AS_IS
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law.\n\n"
) + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\n\nFor more information, please refer to <https://unlicense.org>"
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR_AS_IS),
    ("0BSD", _ISC_GRANT + ".\n\n" + _AUTHOR_AS_IS),
    ("Unlicense", _UNLICENSE),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

#: SHA-256 of the canonical form of long licences as published, whole and (a second row) up to the end of their terms.
DIGESTS = [
    ("Apache-2.0", "af8f65e02d94a7f37247ff54341599c37f7ac89f4f15742e0760f8b649281726"),
    ("Apache-2.0", "e61b202e71647025be848adf5c82383f41c5bc59ea4efd7a3bacda08321b7385"),
    ("Artistic-1.0-Perl", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "8a38d7b267b383bc2736c4ddc361e4692605941aa3d81703ed8dfbb6d13d0404"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3", "ab3bdfecc43ea43524f159924c92c9a4d8db1669ec5667a5d81cd65e4cbbdf64"),
    ("GPL-1.0", "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e"),
    ("GPL-1.0", "a7bce65e5dba16d91866e60621b8ba783a0a808bd63a601f8dc9eee8c8ae3441"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-2.0", "aaf810f79057b02996d56055b9283d413e337af7e865d34d78ee9bb718d44586"),
    ("GPL-3.0", "d664f6713336067583b67e45183bf0206fbe9591ff2a81c357b9c1f2b940b69f"),
    ("GPL-3.0", "edede7dc8d7ece0985b7af302438cbc6e68291e100804bd1fda4e79361855acc"),
    ("LGPL-2.0", "e5d84190aab6a9603e16f3d399fd871e7ca07400ebe661b8d9628887c400cab7"),
    ("LGPL-2.0", "266ff884b67ad1a18c23de3fcd3a85031cd82a9e4b709657b913881289f7befb"),
    ("LGPL-2.1", "ca3d7d43df0c144084b3bc4d30e7e6af5e29a3b2df6ddcfad02555a7a6135656"),
    ("LGPL-2.1", "6d595fe6e15f49c076609b6f6edc3970f501fc3990bd70d30373b0a0c671097a"),
    ("LGPL-3.0", "8b382dd66ce8da3b3b61af92a44dcc9e4dc64c240fefd721ed7bc1022686dbc9"),
    ("MPL-1.1", "3ceafd88024d9d8fa7c4d17039fd8c8ed3c1f5b3d473725c28a0740d97215e38"),
    ("MPL-2.0", "3b80a1a6a10bc176164e59217e6f341fc55a03780933fee211d780571d05949e"),
]


def canonical(c: Column) -> Column:
    c = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, LIST_MARK, "$1"), COPYRIGHT_LINE, "")
    c = F.replace(F.regexp_replace(c, BARE_NOTICE, "$1"), F.lit("&"), F.lit(" and "))
    c = F.trim(F.regexp_replace(c, OUTSIDE, " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def digest(c: Column) -> Column:
    return F.sha2(canonical(c).cast("binary"), 256)


def known_digests(spark) -> DataFrame:
    row = lambda i, d: F.struct(F.lit(i).alias("license_id"), d.alias("digest"))
    rows = F.array(*[row(i, digest(F.lit(t))) for i, t in KNOWN], *[row(i, F.lit(d)) for i, d in DIGESTS])
    return spark.range(1).select(F.explode(rows).alias("k")).select("k.*").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (of the entire text, or null), n_notices, notices (ids of one-line notices, sorted)."""
    known = known_digests(docs.sparkSession)
    lookup = functools.reduce(operator.add, ([F.lit(t), F.lit(i)] for i, t in KNOWN))
    # The map's keys are constants, so the digests in it are computed once by constant folding.
    pairs = F.create_map(*[digest(x) if k % 2 == 0 else x for k, x in enumerate(lookup)])
    notice = r"(?i)licen[sc]|released under|permission"
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(notice))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(pairs, digest(x))), lambda x: x.isNotNull())
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.array_sort(found).alias("found"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join("found", ",").alias("notices"))
