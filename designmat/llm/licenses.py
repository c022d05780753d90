"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences, each is normalised (lower case, runs of other signs to one space) and looked up
among known licence sentences; the row of identifiers, with a mark for each unknown sentence, is then matched
against ordered rules: a rule is a row of identifiers that stand next to each other, and an earlier rule uses up
what it matches. Sentences may be wrapped over lines or stand on lines of their own without a full stop, so both
ways of cutting are read. Numbers of list items are no sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import table

# Sentences of public licences and notices, as a cut at colons, semicolons, stops and blank lines leaves them.
PUBLISHED = {
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MitGrantNotice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MitAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "BsdUse": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ApacheTheLicense": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "ApacheComply": "you may not use this file except in compliance with the License",
    "ApacheTitle": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Gpl3Part": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Gpl2Part": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "Agpl3Part": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Lgpl3Part": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Lgpl21Part": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "GplTerms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LgplTerms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "Later2": "either version 2 of the License, or (at your option) any later version",
    "Later21": "either version 2.1 of the License, or (at your option) any later version",
    "Later3": "either version 3 of the License, or (at your option) any later version",
    "Gpl2Title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "Gpl3Title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Lgpl21Title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "Lgpl3Title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Agpl3Title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MplForm": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "MplTitle": "Mozilla Public License Version 2.0",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty",
    "ZlibLiable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BoostNotice": "Distributed under the Boost Software License, Version 1.0",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "Epl2Notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Epl1Notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "Cc0Deed": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "CcBy": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CcBySa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CcByNc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CcByNcSa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CcByNcNd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CcByNd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "SpdxTag": "SPDX-License-Identifier",
}
# Ordered rules.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitGrantNotice"]),
    ("MIT", ["MitGrant"]),
    ("BSD-3-Clause", ["BsdUse", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdUse", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheTheLicense", "ApacheComply"]),
    ("Apache-2.0", ["ApacheTheLicense"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("GPL-3.0-or-later", ["Gpl3Part"]),
    ("GPL-2.0-or-later", ["Gpl2Part"]),
    ("AGPL-3.0-or-later", ["Agpl3Part"]),
    ("LGPL-3.0-or-later", ["Lgpl3Part"]),
    ("LGPL-2.1-or-later", ["Lgpl21Part"]),
    ("GPL-2.0-or-later", ["GplTerms", "Later2"]),
    ("GPL-3.0-or-later", ["GplTerms", "Later3"]),
    ("LGPL-2.1-or-later", ["LgplTerms", "Later21"]),
    ("LGPL-3.0-or-later", ["LgplTerms", "Later3"]),
    ("GPL-2.0", ["Gpl2Title"]),
    ("GPL-3.0", ["Gpl3Title"]),
    ("LGPL-2.1", ["Lgpl21Title"]),
    ("LGPL-3.0", ["Lgpl3Title"]),
    ("AGPL-3.0", ["Agpl3Title"]),
    ("MPL-2.0", ["MplForm"]),
    ("MPL-2.0", ["MplTitle"]),
    ("ISC", ["IscGrant"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiable", "ZlibGrant"]),
    ("Unlicense", ["Unlicense"]),
    ("BSL-1.0", ["BoostNotice"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("EPL-2.0", ["Epl2Notice"]),
    ("EPL-1.0", ["Epl1Notice"]),
    ("CC0-1.0", ["Cc0Deed"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd"]),
    ("CC-BY-ND-4.0", ["CcByNd"]),
]
# Licences by the names that short statements give them.
NAMES = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL v2 license"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL v3 license"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
FORMS = ["released under", "licensed under", "this work is licensed under", "this project is licensed under", "this project is released under", "this software is licensed under", "this software is released under"]
# Identifiers that may follow the tag of a file's licence.
TAGGED = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "Zlib", "Unlicense", "BSL-1.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
]


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


SENTENCES = {i: plain(s) for i, s in PUBLISHED.items()}
for _name, _forms in NAMES.items():
    for _sentence in [plain(f"{f} {n}") for n in _forms for f in FORMS]:
        _id = "".join(w.capitalize() for w in _sentence.split())
        SENTENCES[_id] = _sentence
        RULES.append((_name, [_id]))
for _name in TAGGED:
    _id = "Is" + "".join(w.capitalize() for w in plain(_name).split())
    SENTENCES[_id] = plain(_name)
    RULES.append((_name, ["SpdxTag", _id]))
#: Every known sentence that a rule begins with holds one of these, so texts without them need no cutting.
HINT = "(?i)license|copyright|redistribut|warranty|permission|public domain|released[^a-z0-9]+under"
#: Blank lines end a sentence too, also those that hold only the marks of a comment.
STOP = r"[.!?;:]+([ \t\r\n\f]|\z)|\n[ \t\r#*/;-]*\n"
LINE = r"[.!?;:]+([ \t\r\n\f]|\z)|[\r\n]+"
#: List numbers and letters are no sentences; holders' names in the third BSD condition are like the template's.
MARKER = "^([0-9]{0,2}|[a-z])$"
HOLDER, TEMPLATE = "^neither the name of .+ nor the names of (its|their) contributors", "neither the name of the copyright holder nor the names of its contributors"


def _identifiers(text: Column, ends: str) -> Column:
    """An identifier for each sentence, a question mark for an unknown one."""
    known = F.str_to_map(F.lit(",".join(f"{s}:{i}" for i, s in SENTENCES.items())), F.lit(","), F.lit(":"))
    cut = F.split(F.regexp_replace(text, ends, "\x01"), "\x01")
    said = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: ~s.rlike(MARKER))
    return F.transform(said, lambda s: F.coalesce(F.try_element_at(known, F.regexp_replace(s, HOLDER, TEMPLATE)), F.lit("?")))


def _matched(ids: Column) -> Column:
    listed = ",".join(f"{name}:{''.join(f'<{i}>' for i in seq)}" for name, seq in RULES)
    rules = F.transform(F.split(F.lit(listed), ","), lambda r: F.struct(F.split_part(r, F.lit(":"), F.lit(1)).alias("name"), F.split_part(r, F.lit(":"), F.lit(2)).alias("seq")))
    row = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    start = F.struct(row.alias("row"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(
        F.replace(acc["row"], r["seq"], F.lit("|")).alias("row"),
        F.when(F.contains(acc["row"], r["seq"]), F.array_append(acc["found"], r["name"])).otherwise(acc["found"]).alias("found"),
    )
    none = F.array().cast("array<string>")
    return F.when(F.exists(ids, lambda i: i != "?"), F.aggregate(rules, start, step)["found"]).otherwise(none)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in text order, lines as sentence ends too), licenses (sorted, comma-joined).

    Null and empty texts give empty strings; every input row gives one row; extra columns are ignored.
    """
    t = F.coalesce("text", F.lit(""))
    hint = t.rlike(HINT)
    by_line, by_stop = _identifiers(t, LINE), _identifiers(t, STOP)
    found = F.array_sort(F.array_union(_matched(by_stop), _matched(by_line)))
    known = F.filter(by_line, lambda i: i != "?")
    return docs.select(
        "doc_id", F.when(hint, F.array_join(known, ",")).otherwise("").alias("sentences"),
        F.when(hint, F.array_join(found, ",")).otherwise("").alias("licenses"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for i, s in SENTENCES.items())

    def ids(ends: str) -> str:
        cut = f"string_split(regexp_replace(t, '{ends}', chr(1), 'g'), chr(1))"
        said = f"list_filter(list_transform({cut}, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: NOT regexp_matches(s, '{MARKER}'))"
        return f"list_transform({said}, lambda s: CASE regexp_replace(s, '{HOLDER}', '{TEMPLATE}') {cases} ELSE '?' END)"

    def chain(k: str) -> str:
        return f"array_to_string(list_transform({k}, lambda i: '<' || i || '>'), '')"

    steps = [f"s0 AS (SELECT doc_id, a, coalesce({chain('a')}, '') AS p, coalesce({chain('b')}, '') AS q, []::VARCHAR[] AS f FROM t)"]
    for k, (name, seq) in enumerate(RULES, 1):
        s = "".join(f"<{i}>" for i in seq)
        steps.append(
            f"s{k} AS (SELECT doc_id, a, replace(p, '{s}', '|') AS p, replace(q, '{s}', '|') AS q,"
            f" CASE WHEN contains(p, '{s}') OR contains(q, '{s}') THEN list_append(f, '{name}') ELSE f END AS f FROM s{k - 1})"
        )
    known = "list_filter(a, lambda i: i <> '?')"
    return (
        f"WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{HINT}') THEN text ELSE '' END AS t FROM documents), t AS (SELECT doc_id, {ids(LINE)} AS a, {ids(STOP)} AS b FROM d), {', '.join(steps)} "
        f"SELECT doc_id, coalesce(array_to_string({known}, ','), '') AS sentences, coalesce(array_to_string(list_sort(list_distinct(f)), ','), '') AS licenses FROM s{len(RULES)}"
    )


ORACLE_SQL = _sql()
