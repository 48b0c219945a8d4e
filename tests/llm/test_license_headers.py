"""Official headers, as their publishers print them."""

from siftmill.llm import licenses

from .test_kernels_and_edges import frame

GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.
"""


def test_official_headers_whose_sentences_are_cut(spark):
    texts = [GPL.format(":", ",", 3), GPL.format(";", ",", 2), APACHE, GPL.format(".\nOther words;", ",", 3), APACHE.replace("License at", "License at:")]
    got = {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    apache = ("Apache-2.0", "apache2_use,apache2_comply,apache2_copy")
    # Words between two parts break the sentence.
    assert got == {0: ("GPL-3.0-or-later", "gpl3_later,gpl_hope"), 1: ("GPL-2.0-or-later", "gpl2_later,gpl_hope"), 2: apache, 3: ("", "gpl_hope"), 4: apache}
