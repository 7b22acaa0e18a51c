"""License scans by canonical digest: DataFrame functions only.

An entire text is brought to a canonical form and its digest is looked up among those of known licences.
Canonical form: lower case; lines of copyright notice dropped; white space, line ends too, made one space;
spellings that licence texts use alike made equal; every run of other characters than letters and digits made
one space; none at the ends. So a text matches however its lines are wrapped.

A line is a notice if it begins with "copyright" and names a holder, a year or (c), with (c) or ©, or with
"all rights reserved". Lines of a wrapped sentence that begin with "copyright notice", "copyright holders"
and the like (OF_LAW) stay.

Defined cases: a null text counts as empty and, like an empty text, matches nothing; repeated rows match
alike; an empty table gives an empty table; the input's other columns are not read. Known licences with
equal canonical texts count as one, under the least name; a text, however long, is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal (pattern, replacement), applied to lower-case text in this order.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("modelling", "modeling"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("fulfil ", "fulfill "),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
    ("&", " and "),
]
# Fixed value: words after "copyright" in sentences of licences, which name no holder unless a colon follows.
OF_LAW = r"(?:and|disclaimers?|holders?|in|interests?|is|laws?|licen[cs]es?|notices?|on|or|owners?|ownership|permissions?|protection|statements?|to|treat(?:y|ies))"
# Fixed value: a line of copyright notice, in lower-case text.
NOTICE_LINE = rf"(?m)^[^\S\n]*(?:copyright[^\S\n]*(?:\(c\)|©|\d{{4}})|copyright\b(?![^\S\n]+{OF_LAW}\b(?!\s*:))(?=[^\n]*[\p{{L}}\p{{N}}])|\(c\)|©|all rights reserved)[^\n]*$"
# Texts of known licences, without their notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
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
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = {
    "MIT": "MIT License\n\n" + MIT,
    "MIT (untitled)": MIT,
    "ISC": "ISC License\n\n" + ISC,
    "ISC (untitled)": ISC,
    "0BSD": "BSD Zero Clause License\n\n" + ZERO_BSD,
    "0BSD (untitled)": ZERO_BSD,
    "BSD-2-Clause": f"BSD 2-Clause License\n\n{BSD_HEAD}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n{BSD_TAIL}",
    "BSD-2-Clause (untitled)": f"{BSD_HEAD}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n{BSD_TAIL}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{BSD_HEAD}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n3. {BSD_3}\n\n{BSD_TAIL}",
    "BSD-3-Clause (untitled)": f"{BSD_HEAD}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n3. {BSD_3}\n\n{BSD_TAIL}",
    "Zlib": "zlib License\n\n" + ZLIB,
    "Zlib (untitled)": ZLIB,
    "Unlicense": UNLICENSE,
    "Apache-2.0 (notice)": APACHE_NOTICE,
    "Apache-2.0 (reference)": "Licensed under the Apache License, Version 2.0.",
    "MIT (reference)": "Released under the MIT License.",
    "GPL-3.0 (reference)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (reference)": "Licensed under CC BY-NC 4.0.",
}

# Digests of the canonical forms of longer licences, whole and, as "terms", without the advice that
# follows their end.
KNOWN_DIGESTS = {
    "Apache-2.0": "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37",
    "Apache-2.0 (terms)": "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-1.0 (terms)": "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-2.0 (terms)": "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "GPL-3.0 (terms)": "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    "LGPL-2.0": "a8f5f57987978c40bffaeb8e6d4038685ceb8cd8489885e1324855efca5380ac",
    "LGPL-2.0 (terms)": "d222a36a2b1ccf8a658f07530f9112e21af962df04221a899ad6bb4c64f7c9c4",
    "LGPL-2.1": "873c6426ea80f22a07042cfb8b3158aa05552910ef41064587e403e155d897e9",
    "LGPL-2.1 (terms)": "21ab10a618f74a48ffcb6704df5fe40782e7250fc3d8d57a7463f7a1f69fe4d3",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
}


def canonical(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    low = F.regexp_replace(low, NOTICE_LINE, " ")
    low = F.regexp_replace(low, r"-[^\S\n]*\n\s*", "-")  # "non-commercial" cut at its hyphen; any other hyphen becomes a space anyway
    low = F.regexp_replace(low, r"[\s\p{Z}]+", " ")
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), r"\bfulfil\b", "fulfill"))


def known_digests(docs: DataFrame, known: dict[str, str] = KNOWN, digests: dict[str, str] = KNOWN_DIGESTS) -> DataFrame:
    """(licence, licence_digest) of texts and of digests; a text that is empty in canonical form is left out."""
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "licence string, text string")
    made = table.select("licence", canonical(F.col("text")).alias("c")).where("c <> ''").select("licence", F.sha2("c", 256).alias("licence_digest"))
    made = made.union(docs.sparkSession.createDataFrame(sorted(digests.items()), "licence string, licence_digest string"))
    return made.groupBy("licence_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_digest, licence): the licence is null where the entire text is none.

    The table of known licences is broadcast up to 100,000 rows; a larger one is joined by shuffle.
    """
    known = known_digests(docs) if known is None else known
    small = known.limit(100_001).count() <= 100_000
    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_digest"))
    right = known.select(F.col("licence_digest").alias("canonical_digest"), "licence")
    return rows.join(F.broadcast(right) if small else right, "canonical_digest", "left").select("doc_id", "canonical_digest", "licence")
