"""Official headers in one table that the query and its SQL both read; and lines, cuts and overlaps against a plain reading."""

import duckdb
import pytest

from siftmill.llm import licenses
from siftmill.llm.queries import license_sql

GNU = """    This {what} is free software{stop} you can redistribute it and/or modify
    it under the terms of the GNU {name}General Public License as published by
    the Free Software Foundation{comma} either version {version} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {name}General Public License for more details.
"""
NEW, OLD = {"stop": ":", "comma": ","}, {"stop": ";", "comma": ";"}
ASIS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.\n'
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http{0}://mozilla.org/MPL/2.0/. */
"""
HEADERS = {
    "GPL-3.0-or-later": GNU.format(what="program", name="", version=3, **NEW),
    "GPL-2.0-or-later": GNU.format(what="program", name="", version=2, **OLD),
    "LGPL-2.1-or-later": GNU.format(what="library", name="Lesser ", version="2.1", **OLD),
    "LGPL-3.0-or-later": GNU.format(what="program", name="Lesser ", version=3, **NEW),
    "AGPL-3.0-or-later": GNU.format(what="program", name="Affero ", version=3, **NEW),
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.
""",
    "MIT": MIT + ASIS,
    "BSD-2-Clause": BSD,
    "MPL-2.0": MPL.format(""),
    "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n\n'
    + ASIS,
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: Text, licences, identifiers (None: whatever the SQL says too).
ODD = [
    ("MIT License\nLicensed under the MIT License.", "MIT-notice", "mit_release"),
    ("My tool\nAll rights reserved\nSome more words here\n", "All-rights-reserved", "rights_reserved"),
    ("This project is\nlicensed under the MIT License.", "MIT-notice", "mit_release"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0", "spdx_apache_20"),
    ("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: MPL-2.0", "MIT,MPL-2.0", "spdx_mit,spdx_mpl_20"),
    ("This program is free software.\nOther words; you can redistribute it and/or modify it.", None, None),
    (MPL.format("s"), "MPL-2.0", None),
    ("Licensed under the MIT License. All rights reserved. Licensed under the MIT License!", None, "mit_release,rights_reserved,mit_release"),
    ("words " * 30_000 + ". Licensed under the MIT License. " + "licence words without end " * 20_000, None, "mit_release"),
    ("", None, None),
    (None, None, None),
    ("no permission at all", None, None),
    ("License: MIT\n\n\n \n***\nAll rights reserved", None, "rights_reserved"),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(k, t) for k, t in enumerate([*HEADERS.values(), *(t for t, *_ in ODD)])] + [(None, HEADERS["MIT"])] * 2 + [(900, HEADERS["MPL-2.0"]), (900, "All rights reserved")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, licenses string, _s int")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cur = con.execute(license_sql())
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ("doc_id", "n_sentences", "sentence_ids", "licenses")]
    return [tuple(r) for r in licenses.scan_licenses(docs).collect()], [tuple(r[i] for i in order) for r in cur.fetchall()]


def test_query_equals_sql(results):
    got, want = results
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_official_header_is_recognised(results):
    got = {r[0]: r[3] for r in results[0] if r[0] is not None and r[0] < len(HEADERS)}
    for k, name in enumerate(HEADERS):
        assert name in got.get(k, "").split(","), (name, got.get(k))
    assert sum(r[0] is None for r in results[0]) == 2 and sum(r[0] == 900 for r in results[0]) == 2


def test_lines_cuts_and_overlaps(results):
    got = {r[0]: r for r in results[0] if r[0] is not None}
    for k, (_, names, ids) in enumerate(ODD, len(HEADERS)):
        if names is not None:
            assert got[k][3] == names, ODD[k - len(HEADERS)][0][:60]
        if ids is not None:
            assert got[k][2] == ids, ODD[k - len(HEADERS)][0][:60]
        if names is None and ids is None:
            assert k not in got
