"""License scans by sentence rules, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of known licence sentences, written as `normalise` leaves them. A bar stands where SENTENCE_END
#: cuts a sentence of the official text in two, at : or ; or an abbreviation or an empty line.
SENTENCES = {
    "mit_release": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "asis_software": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache2_use": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at | http www.apache.org licenses license-2.0"],
    "gpl3_use": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2_use": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl3_later": ["this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 3 of the license or at your option any later version"],
    "gpl2_later": ["this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation | either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc_by_use": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc_by_sa_use": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc_by_nc_use": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "rights_reserved": ["all rights reserved"],
    "lgpl21_later": ["this library is free software | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation | either version 2.1 of the license or at your option any later version"],
    "lgpl3_later": [f"this {x} is free software | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation | either version 3 of the license or at your option any later version" for x in ("library", "program")],
    "lgpl_hope": ["this library is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3_later": ["this program is free software | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation | either version 3 of the license or at your option any later version"],
    "mpl2_use": ["this source code form is subject to the terms of the mozilla public license v | 2.0"],
    "mpl2_copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla.org mpl 2.0" for x in ("http", "https")],
    "epl1_use": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at | http www.eclipse.org legal epl-v10.html"],
    "epl2_use": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at | https www.eclipse.org legal epl-2.0"],
    "unlicense_release": ["this is free and unencumbered software released into the public domain"],
    "unlicense_grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "boost_grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following"],
    "boost_use": ["distributed under the boost software license version 1.0"],
}

#: Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense"]
SENTENCES |= {"spdx_" + x.lower().replace("-", "_").replace(".", ""): [f"spdx-license-identifier | {x.lower()}"] for x in SPDX}

#: Ordered rules: licence, sentence identifiers that must occur in this order, identifiers that must not occur among
#: them or after the last. The first rule of a group that holds wins in the group.
RULES = [
    ("mit", "MIT", ["mit_grant", "mit_notice", "asis_software"], []),
    ("mit", "MIT-partial", ["mit_grant"], []),
    ("mit", "MIT-notice", ["mit_release"], []),
    ("isc", "ISC", ["isc_grant"], []),
    ("bsd", "BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"], []),
    ("bsd", "BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"], ["bsd_endorse"]),
    ("apache", "Apache-2.0", ["apache2_use", "apache2_comply", "apache2_copy"], []),
    ("apache", "Apache-2.0-notice", ["apache2_use"], []),
    ("gpl3", "GPL-3.0-or-later", ["gpl3_later", "gpl_hope"], []),
    ("gpl3", "GPL-3.0-notice", ["gpl3_use"], []),
    ("gpl2", "GPL-2.0-or-later", ["gpl2_later", "gpl_hope"], []),
    ("gpl2", "GPL-2.0-notice", ["gpl2_use"], []),
    ("cc", "CC-BY-NC-4.0", ["cc_by_nc_use"], []),
    ("cc", "CC-BY-SA-4.0", ["cc_by_sa_use"], []),
    ("cc", "CC-BY-4.0", ["cc_by_use"], []),
    ("reserved", "All-rights-reserved", ["rights_reserved"], []),
    ("lgpl", "LGPL-2.1-or-later", ["lgpl21_later", "lgpl_hope"], []),
    ("lgpl", "LGPL-3.0-or-later", ["lgpl3_later", "lgpl_hope"], []),
    ("lgpl", "LGPL-3.0-or-later", ["lgpl3_later", "gpl_hope"], []),
    ("agpl", "AGPL-3.0-or-later", ["agpl3_later", "gpl_hope"], []),
    ("mpl", "MPL-2.0", ["mpl2_use", "mpl2_copy"], []),
    ("mpl", "MPL-2.0-notice", ["mpl2_use"], []),
    ("epl", "EPL-2.0", ["epl2_use"], []),
    ("epl", "EPL-1.0", ["epl1_use"], []),
    ("unlicense", "Unlicense", ["unlicense_release", "unlicense_grant"], []),
    ("unlicense", "Unlicense-notice", ["unlicense_release"], []),
    ("boost", "BSL-1.0", ["boost_grant", "asis_software"], []),
    ("boost", "BSL-1.0-partial", ["boost_grant"], []),
    ("boost", "BSL-1.0-notice", ["boost_use"], []),
    *((i, x, [i], []) for i, x in (("spdx_" + x.lower().replace("-", "_").replace(".", ""), x) for x in SPDX)),
]

#: A sentence ends at . ! ? ; or : before whitespace or the end of the text, and at an empty line.
SENTENCE_END = r"[.!?;:]+(?=[ \t\n\r]|$)|\n[ \t\r]*\n"
#: What normalising turns into one space: all but letters, digits, and dots and hyphens inside words.
NOISE = r"[^a-z0-9.-]+|[.-]+(?=[^a-z0-9]|$)"
#: A text without any of these words has no licence sentence and is not split.
HINTS = r"licen[sc]e|permission|redistribut|copyright|warrant|reserved|free software|endorse|public domain"
#: Parts without any of these are no part of a licence sentence.
PART_HINTS = rf"{HINTS}|without|may |mpl|version|anyone is free|https?:|\b2\.0|^\s*(?:{'|'.join(x.lower() for x in SPDX)})\b"


def normalise(sentence: Column) -> Column:
    """A-Z folded, noise to single spaces, ends trimmed."""
    folded = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, NOISE, " "))


def rule_pattern(ids: list[str], never: list[str]) -> str:
    """A regular expression over the identifiers written as ';a;b;c;'."""
    between = r"(?:[a-z0-9_]+;)*" if not never else f"(?:(?!(?:{'|'.join(never)});)[a-z0-9_]+;)*"
    return ";" + between.join(f"{x};" for x in ids) + (f"{between}$" if never else "")


def sentence_forms(sentence: str) -> list[str]:
    """A known sentence with every choice of its cuts: a line break where it is cut, a space where it is not."""
    forms = [""]
    for k, part in enumerate(sentence.split(" | ")):
        forms = [f + glue + part for f in forms for glue in ((" ", "\n") if k else ("",))]
    return forms


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in order, joined by ','), licenses (in order of the groups, joined by ',').

    One row per document with at least one known sentence. A sentence is a run of whole lines between sentence ends, so that
    a title without a full stop may stand before it; those with cuts may also be whole or lie over several parts in a row. Of sentences that
    overlap, the one that begins first counts, then the longer one. Other sentences may stand between those of a rule. Null
    and empty texts have none. Repeated rows give repeated results, a null key stays null, an empty table gives no rows;
    other columns of the input are left out. One narrow pass: no shuffle, no Python.
    """
    hinted = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).where(F.col("_t").rlike(f"(?i){HINTS}"))
    known = {form: ident for ident, sentences in SENTENCES.items() for s in sentences for form in sentence_forms(s)}
    # Parts are parted by line breaks, lines in a part by ~; parts without a hint stay as "-", so that parts in a row are told from others.
    lines = lambda part: F.array_join(F.filter(F.transform(F.split(part, "\n"), normalise), lambda x: x != ""), "~")
    parts = F.transform(F.split("_t", SENTENCE_END), lambda s: F.when(s.rlike(f"(?i){PART_HINTS}"), lines(s)).when(s.rlike(r"[^ \t\n\r]"), F.lit("-")).otherwise(F.lit("")))
    spelled = hinted.select("doc_id", F.array_join(F.filter(parts, lambda s: s != ""), "\n").alias("_s"))
    any_known = "|".join(re.escape(x).replace(r"\ ", "[ ~]").replace("\\\n", r"\n") for x in sorted(known, key=lambda x: (-len(x), x)))
    found = spelled.select("doc_id", F.regexp_extract_all("_s", F.lit(rf"(?<=^|[~\n])(?:{any_known})(?=$|[~\n])"), F.lit(0)).alias("_f")).where(F.size("_f") > 0)
    names = F.create_map(*[F.lit(x) for form, ident in known.items() for x in (form, ident)])
    some = found.select("doc_id", F.transform("_f", lambda x: F.element_at(names, F.replace(x, F.lit("~"), F.lit(" ")))).alias("_ids")).withColumn("_seq", F.concat(F.lit(";"), F.array_join("_ids", ";"), F.lit(";")))
    groups: dict[str, Column] = {}
    for group, name, ids, never in RULES:
        hit = F.col("_seq").rlike(rule_pattern(ids, never))
        groups[group] = groups[group].when(hit, F.lit(name)) if group in groups else F.when(hit, F.lit(name))
    return some.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(F.array(*groups.values()), ",").alias("licenses"))
