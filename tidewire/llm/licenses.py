"""Licence scan by canonical digests.

Texts are brought to a canonical form (lower case, copyright lines and a licence's title at the head left out, one
spelling for equivalent words and one holder in the clauses that name one, runs of other characters as one blank),
digested, and hash-joined to the digests of known licence texts. Whole texts are looked up, and lines by the same
digests, since a document often names its licence in a line of its own.

The known licences are a table, ``license_id, text``, with a row for each usual variant of a text; a built-in one holds
the texts in ``license_texts``, short licences and customary notices. It is joined without a hint, so its size decides
how.

Defined cases: null, empty and blank texts have no licence; documents with equal texts are looked up each; a licence
text given twice counts as its least id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import lines, written

# Spellings that licence texts use alike, as (found, canonical).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("programme", "program"), ("copyright owner", "copyright holder"), ("https", "http"),
)

# Known licences and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL": "This work is licensed under the GNU General Public License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License v3.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "All-rights-reserved": "All rights reserved.",
}

#: Full texts, a file each.
TEXTS = Path(__file__).parent / "license_texts"

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission.",
)
#: How the conditions of BSD licences are numbered.
_NUMBERS = (("", "", "", ""), ("1", "2", "3", "4"), ("a", "b", "c", "d"), ("i", "ii", "iii", "iv"))

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in table: each text with its usual variants."""
    out = list(KNOWN.items()) + [("Apache-2.0", _APACHE_NOTICE)]
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        # what follows the terms is often left out, with or without the line that ends them
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, terms), (path.stem, terms + end)] if end else []
    mit, isc = KNOWN["MIT"], KNOWN["ISC"]
    out.append(("MIT", mit.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")))
    out.append(("MIT-0", mit.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n", "")))
    out.append(("X11", mit + "\n\nExcept as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."))
    out += [("ISC", isc.replace("modify, and/or distribute", "modify, and distribute")), ("ISC", isc.replace("modify, and/or distribute", "modify and distribute"))]
    for n in _NUMBERS:
        conditions = lambda *parts, n=n: "\n".join(f"{k} {x}" for k, x in zip(n, parts))  # noqa: E731, B905
        out.append(("BSD-2-Clause", _BSD.format(conditions(_SOURCE, _BINARY))))
        for endorse in _ENDORSE:
            out.append(("BSD-3-Clause", _BSD.format(conditions(_SOURCE, _BINARY, endorse))))
            out.append(("BSD-4-Clause", _BSD.format(conditions(_SOURCE, _BINARY, _ADVERTISING, endorse))))
    out.append(("Unlicense", (TEXTS / "Unlicense.txt").read_text().partition("For more information")[0]))
    return out


_VARIANTS = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"
_MARGIN = r"[ \t#*/;%>.-]*"
#: Lines that only name a holder of copyright, with a reservation of all rights in the line after them. A holder's name
#: is told from the words of a licence (also of wrapped lines in capitals) by its capital letter and by what it isn't.
COPYRIGHT_LINE = (
    rf"(?m)^{_MARGIN}(?:(?i:(?:(?:portions|parts)[ \t]+)?copyright:?[ \t]+(?:\(c\)|©|[0-9]{{4}}|by[ \t]|[<\[{{])|\(c\)[ \t]*(?:copyright[ \t]+)?[0-9]{{4}}|©)"
    r"|Copyright:?[ \t]+(?!(?i:holders?|owners?|notices?|and|or|acts?|laws?|licen[sc]es?|rights?|interests?|office|convention|treaty|directive|disclaimer|in|of|for|statements?|information|permission)\b)\p{Lu})"
    rf"[^\n]*$(?:\n{_MARGIN}(?i:all rights reserved)[. \t\r]*$)?"
)
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Title lines at the head of a text in lower case, without its copyright lines.
TITLE = (
    r"\A(?:[\s#*/;%>=.-]*(?:license:[ \t]*)?(?:"
    r"(?:the )?\(?(?:mit|x11|expat|isc|zlib|zlib/libpng|unlicense|0bsd|(?:bsd )?zero[ -]clause(?: bsd)?|(?:new|modified|revised|simplified|original|freebsd|free) bsd|freebsd|bsd|(?:bsd[ -])?[234][ -]clause(?: bsd)?(?: [\"'“”]?(?:new|modified|revised|simplified|original|old|freebsd)[\"'“”]?(?: or [\"'“”]?(?:new|modified|revised|simplified|original|old|freebsd)[\"'“”]?)?)?)\)?(?: licen[sc]e)?(?: \((?:mit|expat|isc|x11|bsd|0bsd|zlib|mit-0|bsd-[234]-clause|[a-z]+ bsd)\))?"
    r"|mit no attribution|bsd-[234]-clause|mit-0"
    r"|boost software licen[sc]e(?: - version 1\.0(?: - august 17th, 2003)?)?"
    r"|apache licen[sc]e|apache software licen[sc]e"
    r"|mozilla public licen[sc]e"
    r"|gnu (?:lesser |library |affero )?general public licen[sc]e|gnu free documentation licen[sc]e"
    r"|creative commons legal code|cc0 1\.0 universal"
    r"|(?:the )?[\"“]?artistic licen[sc]e[\"”]?"
    rf"|version [0-9.]+(?:, (?:[0-9]{{1,2}} )?(?:{_MONTH}) [0-9]{{4}})?|<?https?://www\.apache\.org/licenses/?>?"
    rf")(?:,? (?:version |v)?[0-9]\.[0-9](?:, (?:{_MONTH}) [0-9]{{4}})?)?[ \t\r:.*=#-]*(?:\n|\z)\s*)+"
)
#: Clauses that name a holder or an address, in the form of single blanks, and what stands for them.
CLAUSES = (
    (r"\bneither the names? of .{1,160}? nor the names of (?:its|the|their|any) contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bthis product includes software developed by .{1,160}?(?= (?:[0-9a-z]{1,3} )?(?:neither the name|the names? of))", "this product includes software developed by the organization"),
    (r"\bsoftware is provided by .{1,160}? as is\b", "software is provided by the copyright holders and contributors as is"),
    (r"\bin no event shall .{1,160}? be liable for any\b", "in no event shall the copyright holder be liable for any"),
    (r"(?:^| )(?:51 franklin st(?:reet)? fifth floor boston ma 02110 1301|59 temple place suite 330 boston ma 02111 1307|675 mass(?:achusetts)? ave(?:nue)? cambridge ma 02139) usa\b", ""),
)


def _one_spelling(form: Column) -> Column:
    for a, b in SPELLINGS:
        form = F.regexp_replace(form, rf"\b{a}\b", b)
    return form


def _one_holder(form: Column) -> Column:
    for a, b in CLAUSES:
        form = F.regexp_replace(form, a, b)
    return F.trim(form)


def canonical(texts: Column) -> Column:
    """The canonical form of each text of an array; empty for null and blank texts.

    A step is a pass of its own over the array, since inside one pass an expression that is used twice is made twice.
    """
    has = lambda t, *parts: reduce(or_, map(t.contains, parts))
    given = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    given = F.transform(given, lambda t: F.when(t.rlike(r"[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|\([Cc]\)|©"), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t))
    low = F.transform(given, F.lower)
    low = F.transform(low, lambda t: F.when(t.rlike(TITLE), F.regexp_replace(t, TITLE, "")).otherwise(t))
    plain = F.transform(low, lambda t: F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")))
    plain = F.transform(plain, lambda t: F.when(t.rlike(_VARIANTS), _one_spelling(t)).otherwise(t))
    return F.transform(plain, lambda t: F.when(has(t, "neither the name", "provided by", "in no event shall", "fifth floor", "temple place", "cambridge ma", "developed by"), _one_holder(t)).otherwise(t))


def digests(texts: Column) -> Column:
    """SHA-256 of the canonical form of each text of an array, null where it is empty."""
    return F.transform(canonical(texts), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table: license_id, text."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_license (of the whole text, or null), line_licenses (distinct, joined by commas) and n_license_lines for every row.

    Each row gives the digests of its text and lines; those that are known come back as a map of a row's licences, so
    neither texts nor rows without a licence are shuffled where the known table is small.
    """
    # written, since of a table of constants the optimizer makes a filter that digests every licence again for each line
    known = licenses.select(F.get(digests(F.array("text")), F.lit(0)).alias("known"), "license_id").filter("known is not null").groupBy("known").agg(F.min("license_id").alias("license_id"))
    known = written(known, "known-licenses")
    # the whole text's digest comes first, then those of its lines
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), digests(F.concat(F.array(F.col(text_col)), lines(F.col(text_col)))).alias("digests"))
    rows = written(rows, "digests")
    units = rows.select("row", F.posexplode("digests").alias("at", "digest")).select("row", (F.col("at") == 0).alias("whole"), "digest")
    found = units.join(known, F.col("digest") == F.col("known"))
    line = F.when(~F.col("whole"), F.col("license_id"))
    by_row = found.groupBy("row").agg(F.max(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"), F.array_join(F.sort_array(F.collect_set(line)), ",").alias("line_licenses"), F.count(line).alias("n_license_lines"))
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))
