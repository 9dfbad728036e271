"""The licence scan on texts as they are published."""

import duckdb
import pyarrow as pa
import pytest

from terradelta.llm import licenses

MIT = """MIT License

Copyright (c) 2024 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
ISC = """ISC License

Copyright (c) 2024, A Name

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD3 = BSD2.replace("\nTHIS SOFTWARE", """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
TEXTS = [MIT, APACHE, MPL, GPL2, "".join(f"# {x}\n" for x in APACHE.splitlines()), MIT.replace('"', ""),
         ISC, UNLICENSE, LGPL, AGPL, EPL, CC0, BSD2, BSD3]
WANT = ["MIT", "Apache-2.0", "MPL-2.0", "GPL-2.0-or-later", "Apache-2.0", "MIT",
        "ISC", "Unlicense", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "EPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause"]


def test_published_texts(spark):
    rows = sorted(map(tuple, licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()))
    assert [(r[4], r[5]) for r in rows] == [(w, 0) for w in WANT]
    documents = pa.table({"doc_id": range(len(TEXTS)), "text": TEXTS})  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == rows


def test_a_key_that_is_split_is_refused():
    with pytest.raises(ValueError):
        licenses.table_of({"under the licence, v. 2.0": "x"})


def test_both_readings_count(spark):
    gpl3 = GPL2.replace("Foundation;", "Foundation,").replace("version 2", "version 3")
    texts = ["A line of prose without a full stop\nLicensed under CC BY-NC 4.0.\n\n" + GPL2,
             "prose\nLicensed under CC BY-NC 4.0.\nprose\nMIT License\nprose\nAll rights reserved\nprose\nReleased under the MIT License\nprose.\n\n"
             "This work is licensed under the GNU General\nPublic License, version 3.",
             "prose\nLicensed under CC BY 4.0.\n\n" + gpl3]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    documents = pa.table({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == sorted(map(tuple, found))
    rows = {r.doc_id: r for r in found}
    assert rows[0].licenses == "GPL-2.0-or-later,CC-BY-NC-4.0" and rows[0].sentence_ids.endswith("CC-BY-NC-4-notice") and rows[0].n_unmatched == 0
    assert set(rows[1].licenses.split(",")) == {"CC-BY-NC-4.0", "MIT", "GPL-3.0-only"} and rows[1].n_unmatched == 2
    assert rows[2].licenses == "GPL-3.0-or-later,CC-BY-4.0" and rows[2].n_known == len(rows[2].sentence_ids.split(","))
