"""Licence scans: canonical digests of entire texts, joined with those of known licences."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import written

#: Spellings that count as equal, the first written as the second; those of one word, then those of several.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfill", "fulfil"),
    ("initialise", "initialize"), ("licence", "license"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("recognise", "recognize"), ("utilise", "utilize"),
)
WORD_PAIRS = (("non commercial", "noncommercial"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"))
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A notice names a year, or writes the sign; prose that a wrapped line begins with "copyright" has neither.
COPYRIGHT = r"^((portions )?copyright( c)? ([0-9]{4}|19yy|yyyy|year)( |$)|(portions )?copyright c( |$)|c ([0-9]{4}|yyyy|year) |copyright .*(19|20)[0-9]{2}$|all rights reserved$)"

#: Texts of well-known licences, without their copyright lines.
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software.\n\n" + AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_END),
    ("0BSD", "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC_END),
    ("BSD-2-Clause", BSD_START + BSD_END),
    ("BSD-3-Clause", BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission.\n" + BSD_END),
)
#: One-line notices that stand for a licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
)


#: Digests of longer texts, in each canonical form, whole and up to "END OF TERMS AND CONDITIONS" where they have that line.
DIGESTS = {
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
    ),
    "Artistic-1.0-Perl": (
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2": (
        "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
        "d2ba9b19035ff31cdb03b00d1d99151e954631987feaded2ce4d5d3fd12474e7",
        "8870e5967f922b7e719ec6ce8608bc36161428a3f91512359450b97f2443130f",
    ),
    "GFDL-1.3": (
        "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
        "a6f62b3b6ec0bf3a00dcb7acedb3d54db0ce46811522bf1fff421d6403a45846",
        "06f2f604013cdf1f77b2c7422a98715eb317ca58e126d18e1620acca4e12ce1c",
    ),
    "GPL-1.0": (
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "175f511abd0d3fd5f48cd40e0aaac24652ada233ca289e42f8ffdc9dd5eb8a0e",
        "d408d9dad6e4560274412e743ec3ba01007197655029f60544c308bc54f80499",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d",
        "90b42d1cf0f9ef747c945cda0a54d5bd16341c8491956c54b3f4f283efa0176a",
    ),
    "GPL-2.0": (
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9",
        "0bfb659bf7eeb9921df1446a6a93beba70e0dc947eec10a42d26bb310dccd498",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5",
        "8607b1cff63e9a9dc468bf76327bdd0bb2d2abe09d6e8076427fd49236f46f29",
    ),
    "GPL-3.0": (
        "553d221beaa29d442904386b2d1f1abbe1d8c53de83ad69d4b730cc6d38360b0",
        "6da9bcb8a22485ab39d544ce2d719d1f54af9ebb8636515850eeb897269d48a4",
        "d41ba43477d16feb32fef140cb1b3a415536e379003fead27f51d43d52b969db",
        "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e",
        "9357e482c3cf27d6d738d92d8d67424e093b504361b6b9c0154f100eb6e41c63",
        "ec86de4297578cbd1e3fa78374d42ea37601dc960bd28171af3af1ac080e15bf",
    ),
    "LGPL-2.0": (
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "e7ecb08f240f58455c2c9090ab912b4bb92385869e21cf6d5eddcdcfc74a1731",
        "9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152",
        "9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f",
        "a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b",
        "f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
        "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8",
        "3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2",
    ),
    "MPL-1.1": (
        "65563a4aa777e765df3559c529e0417e293e01dfedce1a4036858cd408aa4f5d",
        "306c97d6d414b6d81e284c065ce46bb98866841c27e12248e4f16e85936a1474",
    ),
    "MPL-2.0": (
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    ),
}
#: Titles that a text may or may not begin with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License"),
}


def _spelled(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def canonical(text: str) -> tuple[str, str, str]:
    """The canonical forms of a text, in plain Python: without copyright lines, without copyright paragraphs, and whole.

    Lower case, words only, equal spellings, one blank between words. A text whose holder's name is wrapped loses it with
    its paragraph, one whose notice stands right before the body with its line, and one that fixes its holder keeps it.
    """
    lines = [_spelled(re.sub(r"[\W_]+", " ", x.replace("©", " c ").lower()).strip(" "), (*SPELLINGS, *WORD_PAIRS)) for x in text.split("\n")]
    blocks = [" ".join(x.split("\n")).strip(" ") for x in re.split("\n\n+", "\n".join(lines))]
    keep = lambda parts: _spelled(" ".join(p for p in parts if p and not re.search(COPYRIGHT, p)), WORD_PAIRS)
    return keep(lines), keep(blocks), _spelled(" ".join(x for x in lines if x), WORD_PAIRS)


def digests(text: str) -> list[str]:
    return [hashlib.sha256(c.encode()).hexdigest() for c in canonical(text)]


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of KNOWN with each of its titles and without one; BSD's conditions numbered or not."""
    out = []
    for name, text in KNOWN:
        titles = TITLES.get(name, ())
        body = next((text.removeprefix(t).lstrip() for t in titles if text.startswith(t + "\n")), text)
        plain = re.sub(r"(?m)^[0-9]\. ", "* ", body)
        out += [(name, f"{t}\n\n{b}" if t else b) for t in ("", *titles) for b in sorted({body, plain})]
    return out


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known texts and notices: KNOWN with its titles, the long texts of DIGESTS, and NOTICES."""
    rows = {(d, name) for name, t in (*known_texts(), *NOTICES) for d in digests(t)}
    rows |= {(d, name) for name, ds in DIGESTS.items() for d in ds}
    return spark.createDataFrame(sorted(rows), "digest string, license string")


def registry(texts: DataFrame) -> DataFrame:
    """(digest, license) of a table of licence texts (license, text), for ``scan``'s ``known``."""
    forms = F.explode(F.array_distinct(F.array(*_digests(_lines(F.col("text"))))))
    return texts.select(forms.alias("digest"), F.col("license")).distinct()


def _spelled_column(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _lines(text: Column) -> Column:
    """The lines of a text, each in canonical form, empty ones and copyright lines included."""
    text = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("©"), F.lit(" c "))
    plain = F.array_join(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(x, NOT_WORD, " "))), "\n")
    return F.split(_spelled_column(plain, (*SPELLINGS, *WORD_PAIRS)), "\n")


def _kept(parts: Column) -> Column:
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def _digests(lines: Column) -> list[Column]:
    """SHA-256 of the three canonical forms."""
    blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))))
    forms = [F.array_join(_kept(lines), " "), F.array_join(_kept(blocks), " "), F.array_join(F.filter(lines, lambda x: x != ""), " ")]
    return [F.sha2(_spelled_column(f, WORD_PAIRS), 256) for f in forms]


def scan(docs: DataFrame, known: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """One row per document: doc_id, digest, license, notices.

    digest: SHA-256 of the canonical form of the entire text without copyright lines; license: the known licence with the
    digest of one of the text's three forms (``canonical``), the first by name, else null; notices: licences whose digest
    is that of an entire line, sorted and comma-joined, empty if none. Null texts count as empty; null and repeated
    doc_ids keep their rows; extra columns are not looked at; no rows give no rows.

    Of up to ``most`` known digests, counted first, the table is sent to the tasks and nothing is shuffled. Larger ones
    are joined by a shuffle of digests, on which lines and documents meet them; texts stay in their task either way.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known.select("digest", "license").where("digest is not null and license is not null").distinct()
    named = known.groupBy("digest").agg(F.min("license").alias("license"), F.array_sort(F.collect_set("license")).alias("licenses"))
    # Lines and digests are values of a row that later expressions only name: each text is read once.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(_lines(F.col("text")))).alias("lines"))
    forms = F.explode(F.array(F.array(*_digests(F.col("lines"))))).alias("forms")
    rows = rows.select("doc_id", F.transform(_kept(F.col("lines")), lambda x: F.sha2(x, 256)).alias("each"), forms)
    few = named.limit(most + 1).collect()
    if len(few) <= most:
        named = F.broadcast(named.select("digest", "license"))
        listed = [r.digest for r in few]
        lookup = F.map_from_entries(F.array(*(F.struct(F.lit(r.digest), F.lit(",".join(r.licenses))) for r in few))) if few else None
        hits = F.filter("each", lambda d: d.isin(listed)) if few else F.array().cast("array<string>")
        names = F.split(F.array_join(F.transform(hits, lambda d: lookup[d]), ","), ",") if few else F.array().cast("array<string>")
        out = rows.select("doc_id", "forms", F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), ",").alias("notices"))
    else:
        rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "licence-digests")
        met = rows.select("row_id", F.explode(F.array_distinct("each")).alias("digest")).join(named.select("digest", "licenses"), "digest")
        found = met.select("row_id", F.explode("licenses").alias("l")).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("notices"))
        out = rows.join(found, "row_id", "left").select("doc_id", "forms", F.coalesce("notices", F.lit("")).alias("notices"))
        named = named.select("digest", "license")
    for k in range(3):
        out = out.join(named.select(F.col("digest").alias(f"d{k}"), F.col("license").alias(f"l{k}")), F.col("forms")[k] == F.col(f"d{k}"), "left")
    return out.select("doc_id", F.col("forms")[0].alias("digest"), F.least("l0", "l1", "l2").alias("license"), "notices")


def oracle() -> str:
    """DuckDB SQL of ``scan`` over documents with the known digests."""
    def spelled(x: str, pairs) -> str:
        for a, b in pairs:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    rows = {(d, name) for name, t in (*known_texts(), *NOTICES) for d in digests(t)} | {(d, name) for name, ds in DIGESTS.items() for d in ds}
    values = ", ".join(f"('{d}', '{name}')" for d, name in sorted(rows))
    line = spelled("trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))", (*SPELLINGS, *WORD_PAIRS))
    kept = f"lambda x: x <> '' and not regexp_matches(x, '{COPYRIGHT}')"
    form = lambda parts: f"sha256({spelled(f'array_to_string({parts}, chr(32))', WORD_PAIRS)})"
    return f"""
with known(digest, license) as (values {values}),
rows as (
  select doc_id, row_number() over () as row_id,
         list_transform(string_split(replace(coalesce(text, ''), '©', ' c '), chr(10)), lambda x: {line}) as lines
  from documents
), parts as (
  select *, list_filter(lines, {kept}) as own,
         list_filter(list_transform(string_split_regex(array_to_string(lines, chr(10)), '\n\n+'), lambda x: trim(replace(x, chr(10), ' '))), {kept}) as blocks
  from rows
), forms as (
  select doc_id, row_id, own, {form("own")} as d0, {form("blocks")} as d1, {form("list_filter(lines, lambda x: x <> '')")} as d2 from parts
), found as (
  select row_id as of, string_agg(license, ',' order by license) as notices
  from (select distinct row_id, license from (select row_id, sha256(unnest(own)) as digest from forms) join known using (digest))
  group by row_id
)
select doc_id, d0 as digest, (select min(license) from known k where k.digest in (d0, d1, d2)) as license, coalesce(notices, '') as notices
from forms left join found on row_id = of
"""
