"""Licences of files: TF-IDF cosine of texts, header blocks and lines to templates, then inheritance from the nearest
directory above.

A file is compared in units: its whole text if it is a licence file, runs of paragraphs that speak of licences, runs of
such lines, and each such line, all without comment signs and as words alone, so wrapping makes no difference. Units
are reduced to distinct ones before they are compared, so a notice that stands in a third of all files is one row. A
unit's vector weighs its words by how few of the distinct units and templates hold them; it matches the template with
the largest cosine from ``least`` on. Templates are full licence texts (``licence_texts``), standard notices and titles.
A file has the licence of its SPDX tag; else that of its largest kind of unit that matches, and of these the best one.
The licence of a directory is that of its best licence file; a file without one of its own takes that of the nearest
directory above that has one.

Results of odd rows: a null or empty text has no unit; a null path has no directory and inherits nothing; equal cosines
go to the template, then the path, first in order; of several SPDX tags the first counts, expressions and ids that are
not listed stay as written; repeated rows are judged one by one. A text of any length is read whole; a very long licence
file is one unit, taken apart into words by Spark in one task. Columns other than the path, the text, the flag and ``keep`` are not
read; ``keep`` must not name a result column.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Names of each licence. A name without a version says no more than the family, unless only one version is in use.
TITLES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache License"),
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSD": ("BSD License",),
    "GPL": ("GNU General Public License", "GNU GPL license"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2 license", "GPLv2 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3 license", "GPLv3 license"),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1 license", "LGPLv2.1 license"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3 license", "LGPLv3 license"),
    "AGPL-3.0": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPLv3 license"),
    "MPL-2.0": ("Mozilla Public License", "Mozilla Public License, version 2.0"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal license", "CC0 license"),
    "CC-BY-4.0": ("CC BY 4.0 license", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "Artistic-1.0-Perl": ("The Artistic License",),
}
FORMS = ("{}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}")
FREE = ("This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by "
        "the Free Software Foundation, {1}.")
REST = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received "
        "a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/.")
GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
       ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
       ("AGPL-3.0", "GNU Affero General Public License", "3"))
APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
          "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
#: Standard notices of files, and the sentences by which a part of one is told.
NOTICES = (
    ("Apache-2.0", APACHE), ("Apache-2.0", APACHE + ' Unless required by applicable law or agreed to in writing, software distributed '
     'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
    *[(family, f"it under the terms of the {name} as published by") for family, name in (
        ("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL-3.0", "GNU Affero General Public License"))],
    *[(licence, FREE.format(name, which.format(v)) + rest.format(name)) for licence, name, v in GNU for rest in ("", REST)
      for which in ("either version {} of the License, or (at your option) any later version", "version {} of the License")],
)
TEXTS = Path(__file__).with_name("licence_texts")
#: What the text of the AGPL has in place of the GPL's section 13; the rest of it is the GPL's but for the name.
NETWORK = """13. Remote Network Interaction; Use with the GNU General Public License.

Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all
users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive
the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through
some standard or customary means of facilitating copying of software.

"""
SPEAKS = r"(?i)licen[cs]|permission|redistribut|copyright"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([a-z0-9.+\-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[a-z0-9.+()\-]+)*)"
RESULTS = ("path", "licence", "origin", "cosine", "from_directory")
WHOLE, PARAGRAPHS, LINES, LINE = 1, 2, 3, 4     # kinds of units, the one that decides first


def templates() -> list[tuple[str, str]]:
    """Licence and text of each template."""
    full = {p.name.removesuffix(".txt"): p.read_text() for p in sorted(TEXTS.glob("*.txt"))}
    gpl = full["GPL-3.0"]
    own = gpl[:gpl.index("  13. Use with")].replace("GNU General Public", "GNU Affero General Public")
    full["AGPL-3.0"] = own + NETWORK + gpl[gpl.index("  14. Revised Versions"):].replace("GNU General Public", "GNU Affero General Public")
    short = [(licence, form.format(title)) for licence, titles in TITLES.items() for title in titles for form in FORMS]
    return [*full.items(), *NOTICES, *short]


def words(text: str | Column) -> Column:
    """Words of letters, digits and inner dots, in lower case."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^a-z0-9.]+|\.+(?=[^a-z0-9]|$)"), lambda w: w != "")


def matches(units: DataFrame, least: float) -> DataFrame:
    """``units`` has unit, a distinct key, and text, words with a space between. Returns unit, licence and cosine of those
    that match."""
    spark = units.sparkSession
    listed = templates()
    known = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(listed)], "template int, licence string, text string")
    own = units.select("unit", F.explode(F.split("text", " ")).alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))
    theirs = known.select("template", "licence", F.explode(words("text")).alias("word")).groupBy("template", "licence", "word").agg(F.count("*").alias("tf"))
    held = own.select("word").unionAll(theirs.select("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = units.agg(F.count(F.lit(1))).scalar() + F.lit(len(listed))
    weighed = held.select("word", (F.log((F.lit(1.0) + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    a = own.join(weighed, "word").select("unit", "word", (F.col("tf") * F.col("idf")).alias("x"))
    b = theirs.join(weighed, "word").select("template", "licence", "word", (F.col("tf") * F.col("idf")).alias("y"))
    a_norm = a.groupBy(F.col("unit").alias("_unit")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    b_norm = b.groupBy(F.col("template").alias("_template")).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    dots = a.join(F.broadcast(b), "word").groupBy("unit", "template", "licence").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = (dots.join(a_norm, F.col("unit") == F.col("_unit")).join(F.broadcast(b_norm), F.col("template") == F.col("_template"))
              .select("unit", "licence", F.round(F.col("dot") / (F.col("nx") * F.col("ny")), 6).alias("cosine")))
    return (scored.filter(F.col("cosine") >= least).groupBy("unit").agg(
        F.min_by("licence", F.struct(-F.col("cosine"), "licence")).alias("licence"), F.max("cosine").alias("cosine")))


def without_signs(text: str) -> Column:
    """The text without the comment signs at the start and end of its lines."""
    begun = F.regexp_replace(F.col(text), r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|dnl\b)?[ \t]*", "")
    return F.regexp_replace(begun, r"(?m)[ \t]*(?:\*+/|-->)?[ \t\r]*$", "")


def runs(parts: Column) -> Column:
    """Neighbouring parts that speak of licences, put together."""
    marked = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(SPEAKS), x).otherwise("\u0001")), "\n")
    return F.filter(F.split(marked, "\u0001"), lambda x: x.rlike(SPEAKS))


def tagged(text: str) -> Column:
    """The licence of the first SPDX tag, null if there is none; "only" and "or later" are left out of a single id."""
    found = F.regexp_extract(F.col(text), SPDX, 1)
    one = F.regexp_replace(found, r"(?i)^(\S+?)(?:-only|-or-later|\+)$", "$1")
    listed = F.create_map(*[F.lit(x) for name in TITLES for x in (name.lower(), name)])
    return F.when(found != "", F.coalesce(F.element_at(listed, F.lower(one)), one))


def units_of(text: str, whole: str) -> Column:
    """The distinct units of a text as (kind, text)."""
    lines, paragraphs = F.split(F.col(text), "\n"), F.split(F.col(text), r"\n\s*\n")
    kinds = ((WHOLE, F.when(F.col(whole), F.array(F.col(text))).otherwise(F.array().cast("array<string>"))), (PARAGRAPHS, runs(paragraphs)),
             (LINES, runs(lines)), (LINE, F.filter(lines, lambda x: x.rlike(SPEAKS))))

    def of_kind(k: int, parts: Column) -> Column:
        return F.transform(parts, lambda t: F.struct(F.lit(k).alias("kind"), t.alias("text")))

    every = F.concat(*[of_kind(k, parts) for k, parts in kinds])
    plain = F.transform(every, lambda u: F.struct(u["kind"].alias("kind"), F.array_join(words(u["text"]), " ").alias("text")))
    return F.array_distinct(F.filter(plain, lambda u: u["text"] != ""))


def directories(path: str) -> Column:
    """The directories above a file, nearest first, as (directory, depth)."""
    parts = F.split(F.col(path), "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.struct(
        F.array_join(F.slice(parts, 1, k), "/").alias("directory"), k.alias("depth"))))


def scan(files: DataFrame, path: str, text: str, is_licence_file: Column, keep: list[str], least: float = 0.6) -> DataFrame:
    """Returns the columns ``keep``, path, licence, origin (``header``, ``directory`` or ``none``), cosine and the
    directory that an inherited licence comes from."""
    clash = [c for c in keep if c in RESULTS]
    if clash:
        raise ValueError(f"keep names result columns: {', '.join(clash)}")
    base = files.select(*keep, F.col(path).alias("path"), F.coalesce(is_licence_file, F.lit(False)).alias("_file"),
                        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    speaks = (F.col("_file") & (F.col("_text") != "")) | F.col("_text").rlike(SPEAKS)
    key = F.when(speaks, F.md5(F.concat(F.col("_file").cast("string"), F.col("_text"))))
    base = base.withColumn("_copy", key)
    marks = saved(base.drop("_text"), "licence-marks")      # files are read for these, and once more for the texts that speak of licences
    # Copies are taken apart once: equal files are one row here.
    copies = base.filter("_copy is not null").groupBy("_copy").agg(F.first("_file").alias("_file"), F.first("_text").alias("_text"))
    held = copies.select("_copy", tagged("_text").alias("_tag"), without_signs("_text").alias("_text"), "_file")
    parts = saved(held.select("_copy", "_tag", F.explode_outer(units_of("_text", "_file")).alias("u"))
                  .select("_copy", "_tag", "u.kind", F.md5("u.text").alias("unit"), "u.text"), "licence-units")
    found = matches(parts.filter("unit is not null").groupBy("unit").agg(F.first("text").alias("text")), least)
    by_unit = parts.select("_copy", "kind", "unit").join(found, "unit").select("_copy", "kind", "licence", "cosine")
    by_tag = parts.filter("_tag is not null").select("_copy", F.lit(0).alias("kind"), F.col("_tag").alias("licence"), F.lit(1.0).alias("cosine"))
    best = F.struct("kind", -F.col("cosine"), "licence")
    of_copy = (by_unit.unionByName(by_tag).groupBy(F.col("_copy").alias("_of"))
               .agg(F.min_by(F.struct("licence", "cosine"), best).alias("m")).select("_of", "m.licence", "m.cosine"))
    silent = marks.filter("_copy is null").drop("_copy").withColumns({c: F.lit(None).cast(t) for c, t in of_copy.dtypes if c != "_of"})
    matched = (marks.filter("_copy is not null").join(of_copy, F.col("_copy") == F.col("_of"), "left").drop("_copy", "_of")
               .unionByName(silent))
    nearest = (matched.filter(F.col("_file") & F.col("licence").isNotNull() & F.col("path").isNotNull())
               .select(F.element_at(directories("path"), 1)["directory"].alias("_directory"), "licence", "cosine", "path")
               .filter("_directory is not null").groupBy("_directory")
               .agg(F.min_by("licence", F.struct(-F.col("cosine"), "licence", "path")).alias("_inherited")))
    # Distinct directories of files, with the nearest one above that has a licence.
    places = marks.select(F.regexp_replace("path", "/[^/]*$", "/").alias("_place")).filter("_place like '%/'").distinct()
    above = places.select("_place", F.explode(directories("_place")).alias("d")).select("_place", "d.directory", "d.depth")
    given = (above.join(nearest, F.col("directory") == F.col("_directory")).groupBy("_place")
             .agg(F.max_by(F.struct("directory", "_inherited"), "depth").alias("g")))
    out = matched.withColumn("_at", F.regexp_replace("path", "/[^/]*$", "/")).join(given, F.col("_at") == F.col("_place"), "left")
    own = F.col("licence").isNotNull()
    return out.select(
        *keep, "path", F.coalesce("licence", F.col("g._inherited")).alias("licence"),
        F.when(own, "header").when(F.col("g").isNotNull(), "directory").otherwise("none").alias("origin"),
        "cosine", F.when(~own, F.col("g.directory")).alias("from_directory"))
