"""Licence scan by sentence rules, in DataFrame expressions alone.

A text is normalised (lower case, comment marks, quotes and white space folded to single spaces), cut into sentences, and
each sentence is looked up among known licence sentences. The identifiers found, in order, are then matched against
ordered licence rules: a rule is a run of identifiers; longer and more specific rules come first and use up what they
match, so that a general rule only sees what is left.

A text is read twice: once with sentences running over line ends up to an empty line (wrapped licence texts) and once with every line end
closing a sentence (one-line notices below lines without a full stop). The rules are matched on both readings, and the
licences of either count. The identifiers are those of the reading with more known sentences (the first on a tie), then
those only the other reading has.

Defined cases: null and empty texts have no sentence and no licence; all of a text is read; equal texts get equal
values; repeated notices give repeated identifiers and each licence once; repeated rows are scanned each; an empty table
gives no row. Only id and text are read, other columns may have any name. No shuffle: a document is scanned in its own row, and the rule tables are literals of the plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as they read after normalisation, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-notice",
    "licensed under the mit license": "MIT-notice",
    "this project is licensed under the mit license": "MIT-notice",
    "the mit license (mit)": "MIT-title",
    "mit license": "MIT-title",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice-kept",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MIT-as-is",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MIT-liability",
    "licensed under the apache license, version 2.0": "Apache-2-notice",
    "licensed under the apache license, version 2.0 (the license)": "Apache-2-notice",
    "you may not use this file except in compliance with the license": "Apache-2-comply",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "Apache-2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "Apache-2-see",
    "this work is licensed under the gnu general public license, version 3": "GPL-3-notice",
    "licensed under the gnu general public license, version 3": "GPL-3-notice",
    "this program is free software": "GPL-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPL-3-plus-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation, either version 2 of the license, or (at your option) any later version": "GPL-2-plus-terms",
    "this program is distributed in the hope that it will be useful, but without any warranty": "GPL-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-implied",
    "see the gnu general public license for more details": "GPL-see",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSD-grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-endorse",
    "licensed under cc by 4.0": "CC-BY-4-notice",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4-notice",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "CC-BY-4-notice",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CC-BY-SA-4-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CC-BY-NC-4-notice",
    "all rights reserved": "all-rights",
}

# The ordered rules, each a run of identifiers and the licence it proves.
RULES = (
    (("MIT-title", "MIT-grant", "MIT-notice-kept", "MIT-as-is", "MIT-liability"), "MIT"),
    (("MIT-grant", "MIT-notice-kept", "MIT-as-is", "MIT-liability"), "MIT"),
    (("Apache-2-notice", "Apache-2-comply", "Apache-2-link", "Apache-2-as-is", "Apache-2-see"), "Apache-2.0"),
    (("GPL-free", "GPL-3-plus-terms", "GPL-hope", "GPL-implied", "GPL-see"), "GPL-3.0-or-later"),
    (("GPL-free", "GPL-2-plus-terms", "GPL-hope", "GPL-implied", "GPL-see"), "GPL-2.0-or-later"),
    (("GPL-free", "GPL-3-plus-terms"), "GPL-3.0-or-later"),
    (("GPL-free", "GPL-2-plus-terms"), "GPL-2.0-or-later"),
    (("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"), "BSD-3-Clause"),
    (("BSD-grant", "BSD-source", "BSD-binary"), "BSD-2-Clause"),
    (("MIT-notice",), "MIT"),
    (("Apache-2-notice",), "Apache-2.0"),
    (("GPL-3-notice",), "GPL-3.0-only"),
    (("CC-BY-4-notice",), "CC-BY-4.0"),
    (("CC-BY-SA-4-notice",), "CC-BY-SA-4.0"),
    (("CC-BY-NC-4-notice",), "CC-BY-NC-4.0"),
    (("MPL-2-notice",), "MPL-2.0"),
)

# Marks that stand for a space, the space itself; an empty (or only marked) line; and what closes a sentence: . ; : ! ?
# before a space or the end.
MARKS = r"[ \t\r\n\f*#/\"'`“”‘’]+"
EMPTY_LINE = r"\n[ \t\r\n\f*#/]*\n"
CLOSE = r"[.;:!?]+(?: |$)"


def sentences(text: Column, line_ends: bool) -> Column:
    """The normalised sentences of a text that hold anything."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, F.lit(r"[\r\n]+" if line_ends else EMPTY_LINE), F.lit(". "))
    flat = F.regexp_replace(low, F.lit(MARKS), F.lit(" "))
    return F.filter(F.transform(F.split(flat, CLOSE), lambda s: F.trim(s)), lambda s: s != "")


# Further sentences as they are published, one sentence each after normalisation (a link is cut behind its
# "http:", "v. 2.0" behind its "v").
PUBLISHED = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "MIT-grant",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT-as-is",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2-notice",
    "You may obtain a copy of the License at": "Apache-2-obtain",
    "You may obtain a copy of the License at http:": "Apache-2-obtain",
    "You may obtain a copy of the License at https:": "Apache-2-obtain",
    "www.apache.org/licenses/LICENSE-2.0": "Apache-2-link",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;": "GPL-terms",
    "either version 2 of the License, or (at your option) any later version.": "GPL-2-plus",
    "either version 3 of the License, or (at your option) any later version.": "GPL-3-plus",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v.": "MPL-2-notice",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http:": "MPL-2-obtain",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https:": "MPL-2-obtain",
    "mozilla.org/MPL/2.0/.": "MPL-2-link",
    "ISC License": "ISC-title",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC-grant",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.': "ISC-as-is",
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.": "ISC-liability",
    "This is free and unencumbered software released into the public domain.": "Unlicense-free",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense-anyone",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;": "LGPL-terms",
    "either version 2.1 of the License, or (at your option) any later version.": "GNU-2.1-plus",
    "This library is free software;": "LGPL-free",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "LGPL-hope",
    "See the GNU Lesser General Public License for more details.": "LGPL-see",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3-plus-terms",
    "See the GNU Affero General Public License for more details.": "AGPL-see",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https:": "EPL-2-notice",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http:": "EPL-2-notice",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "CC0-dedicated",
    "This software is distributed without any warranty.": "CC0-no-warranty",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.': "BSD-as-is",
}


def cut(text: str) -> list[str]:
    """:func:`sentences` of one sentence of a table, outside Spark."""
    return [s for s in (x.strip(" ") for x in re.split(CLOSE, re.sub(MARKS, " ", text.lower()))) if s]


def table_of(entries: dict[str, str]) -> dict[str, str]:
    """``entries`` with keys as the normalisation leaves them; a key that it splits could never be met and is an error."""
    split = [k for k in entries if len(cut(k)) != 1]
    if split:
        raise ValueError(f"no single sentence after normalisation: {split}")
    return {cut(k)[0]: v for k, v in entries.items()}


KNOWN = table_of(SENTENCES | PUBLISHED)  # what sentences are looked up in

ALL_RULES = (
    *RULES[:2],
    (("Apache-2-notice", "Apache-2-comply", "Apache-2-obtain", "Apache-2-link", "Apache-2-as-is", "Apache-2-see"), "Apache-2.0"),
    (("GPL-free", "GPL-terms", "GPL-3-plus", "GPL-hope", "GPL-implied", "GPL-see"), "GPL-3.0-or-later"),
    (("GPL-free", "GPL-terms", "GPL-2-plus", "GPL-hope", "GPL-implied", "GPL-see"), "GPL-2.0-or-later"),
    (("GPL-free", "GPL-terms", "GPL-3-plus"), "GPL-3.0-or-later"),
    (("GPL-free", "GPL-terms", "GPL-2-plus"), "GPL-2.0-or-later"),
    (("MPL-2-notice", "MPL-2-obtain", "MPL-2-link"), "MPL-2.0"),
    (("GPL-free", "AGPL-3-plus-terms", "GPL-hope", "GPL-implied", "AGPL-see"), "AGPL-3.0-or-later"),
    (("GPL-free", "AGPL-3-plus-terms"), "AGPL-3.0-or-later"),
    (("LGPL-free", "LGPL-terms", "GNU-2.1-plus", "LGPL-hope", "GPL-implied", "LGPL-see"), "LGPL-2.1-or-later"),
    (("GPL-free", "LGPL-terms", "GPL-3-plus", "GPL-hope", "GPL-implied", "LGPL-see"), "LGPL-3.0-or-later"),
    (("ISC-title", "ISC-grant", "ISC-as-is", "ISC-liability"), "ISC"),
    (("ISC-grant", "ISC-as-is", "ISC-liability"), "ISC"),
    (("Unlicense-free", "Unlicense-anyone"), "Unlicense"),
    (("CC0-dedicated", "CC0-no-warranty"), "CC0-1.0"),
    (("EPL-2-notice",), "EPL-2.0"),
    (("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-as-is"), "BSD-3-Clause"),
    (("BSD-grant", "BSD-source", "BSD-binary", "BSD-as-is"), "BSD-2-Clause"),
    *RULES[2:],
)


def known(found: Column, table: dict[str, str]) -> Column:
    """Identifiers of the known sentences among ``found``, in order."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(F.filter(found, lambda s: s.isin(list(table))), lambda s: F.element_at(lookup, s))


def scan(docs: DataFrame, table: dict[str, str] = KNOWN, rules: tuple = ALL_RULES) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids (in order), licenses (in the rules' order, each once), n_unmatched.

    ``sentence_ids`` and ``licenses`` are joined by commas. ``n_unmatched`` counts known sentences no rule has used.
    """
    df = docs.select("doc_id", sentences(F.col("text"), False).alias("runs"), sentences(F.col("text"), True).alias("lines"))
    df = df.select("doc_id", F.size("runs").cast("long").alias("n_sentences"), known(F.col("runs"), table).alias("a"), known(F.col("lines"), table).alias("b"))
    more = F.size("b") > F.size("a")
    df = df.select("doc_id", "n_sentences", F.when(more, F.col("b")).otherwise(F.col("a")).alias("ids"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("other"))
    run_of = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(";"), F.concat_ws(";;", c), F.lit(";"))).otherwise(F.lit(""))
    df = df.withColumn("extra", F.array_except("other", "ids"))
    both = F.concat("ids", "extra")
    df = df.select("doc_id", "n_sentences", F.size(both).cast("long").alias("n_known"), F.concat_ws(",", both).alias("sentence_ids"), "extra",
                   run_of("ids").alias("left"), run_of("other").alias("left_other"), F.lit("").alias("hits"))

    def step(frame: DataFrame, rule: tuple) -> DataFrame:
        run = "".join(f";{x};" for x in rule[0])
        found = F.when(F.contains("left", F.lit(run)) | F.contains("left_other", F.lit(run)), F.concat("hits", F.lit(f"{rule[1]},"))).otherwise(F.col("hits"))
        # what the rule has used leaves a bar, so that what stood before and after it is not taken for one run
        return frame.withColumns({"hits": found, "left": F.replace("left", F.lit(run), F.lit("|")), "left_other": F.replace("left_other", F.lit(run), F.lit("|"))})

    df = reduce(step, rules, df)
    licenses = F.concat_ws(",", F.array_distinct(F.filter(F.split("hits", ","), lambda s: s != "")))
    unmatched = (F.length("left") - F.length(F.replace("left", F.lit(";"), F.lit("")))) / 2
    unmatched = unmatched + F.size(F.array_intersect(F.split("left_other", "[;|]+"), "extra"))
    return df.select("doc_id", "n_sentences", "n_known", "sentence_ids", licenses.alias("licenses"), unmatched.cast("long").alias("n_unmatched"))


def oracle(table: dict[str, str] = KNOWN, rules: tuple = ALL_RULES) -> str:
    """The scan of both readings in the check engine's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    marks = r"""'[ \t\r\n\f*#/"''`\x{201c}\x{201d}\x{2018}\x{2019}]+'"""
    cut = lambda text: (f"list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, {marks}, ' ', 'g'), '{CLOSE}'), "  # noqa: E731
                        "lambda s: trim(s, ' ')), lambda s: s <> '')")
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in table.items())
    steps = []
    for i, (run, name) in enumerate(rules):
        text = q("".join(f";{x};" for x in run))
        steps.append(f"r{i + 1} AS (SELECT * REPLACE (CASE WHEN contains(left_, {text}) OR contains(left_other, {text}) THEN hits || {q(name + ',')} ELSE hits END AS hits, "
                     f"replace(left_, {text}, '|') AS left_, replace(left_other, {text}, '|') AS left_other) FROM r{i})")
    run_of = lambda c: f"CASE WHEN len({c}) > 0 THEN ';' || array_to_string({c}, ';;') || ';' ELSE '' END"
    return f"""WITH known(k, id) AS (VALUES {rows}),
low AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
cuts AS (SELECT r, doc_id, {cut(f"regexp_replace(t, '{EMPTY_LINE}', '. ', 'g')")} AS runs, {cut("regexp_replace(t, '[' || chr(13) || chr(10) || ']+', '. ', 'g')")} AS lines FROM low),
hit_a AS (SELECT r, list(id ORDER BY i) AS a FROM (SELECT r, unnest(runs) AS s, generate_subscripts(runs, 1) AS i FROM cuts) JOIN known ON s = k GROUP BY r),
hit_b AS (SELECT r, list(id ORDER BY i) AS b FROM (SELECT r, unnest(lines) AS s, generate_subscripts(lines, 1) AS i FROM cuts) JOIN known ON s = k GROUP BY r),
met AS (SELECT doc_id, len(runs)::BIGINT AS n_sentences, coalesce(a, []) AS a, coalesce(b, []) AS b FROM cuts LEFT JOIN hit_a USING (r) LEFT JOIN hit_b USING (r)),
best AS (SELECT doc_id, n_sentences, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids, CASE WHEN len(b) > len(a) THEN a ELSE b END AS other FROM met),
more AS (SELECT *, list_filter(other, lambda x, i: NOT list_contains(ids, x) AND list_position(other, x) = i) AS extra FROM best),
r0 AS (SELECT doc_id, n_sentences, (len(ids) + len(extra))::BIGINT AS n_known, array_to_string(ids || extra, ',') AS sentence_ids, extra,
  {run_of('ids')} AS left_, {run_of('other')} AS left_other, '' AS hits FROM more),
{", ".join(steps)},
named AS (SELECT *, string_split(hits, ',') AS names, regexp_split_to_array(left_other, '[;|]+') AS rest FROM r{len(rules)})
SELECT doc_id, n_sentences, n_known, sentence_ids, array_to_string(list_filter(names, lambda x, i: x <> '' AND list_position(names, x) = i), ',') AS licenses,
  ((length(left_) - length(replace(left_, ';', ''))) // 2 + len(list_filter(extra, lambda x: list_contains(rest, x))))::BIGINT AS n_unmatched FROM named"""
