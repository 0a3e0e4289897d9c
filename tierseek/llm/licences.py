"""Licence scans: lines and paragraphs against licence notices, by Dice coefficient over sets of word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierseek.llm.common import let

THRESHOLD = 0.8
#: Short public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Artistic-2.0": "Licensed under the Artistic License 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause-short": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-short": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "Licensed under the Eclipse Public License 2.0.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-notice": "This project is licensed under the terms of the MIT license.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "proprietary": "All rights reserved.",
}
#: The GNU licences: name, version, and what their long notice calls the work.
GNU = {
    "AGPL-3.0": ("GNU Affero General Public License", "3", "program"),
    "FDL-1.3": ("GNU Free Documentation License", "1.3", None),
    "GPL-2.0": ("GNU General Public License", "2", "program"),
    "GPL-3.0": ("GNU General Public License", "3", "program"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3", "library"),
}
for _key, (_name, _version, _work) in GNU.items():
    TEMPLATES[f"{_key}-notice"] = f"This work is licensed under the {_name}, version {_version}."
    TEMPLATES[f"{_key}-short"] = f"Licensed under the {_name}, version {_version}."
    TEMPLATES[f"{_key}-v"] = f"Licensed under the {_name} v{_version if '.' in _version else _version + '.0'}."
    if _work:
        TEMPLATES.setdefault(_key, f"This {_work} is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version.")


def bigrams(text: Column) -> Column:
    """The set of word bigrams of a normalised text: lower case, words of ASCII letters and digits."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.array_distinct(let(words, pairs))


def _template_bigrams(text: str) -> list[str]:
    import re

    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _gate(templates: list[list[str]], threshold: float) -> str:
    """A pattern that any part with a Dice coefficient of threshold or more contains, in lower case.

    Such a part holds at least t / (2 - t) of the template's bigrams, so it holds one of any larger share than the rest; the
    longest bigrams are taken, which are the rarest.
    """
    chosen = set()
    for b in templates:
        missing = int(len(b) * (1 - threshold / (2 - threshold)) + 1e-9)
        chosen |= {*sorted(b, key=lambda x: (-len(x), x))[: missing + 1]}
    return "(?<![a-z0-9])(?:" + "|".join(sorted(x.replace(" ", "[^a-z0-9]+") for x in chosen)) + ")(?![a-z0-9])"


def scan(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """df with licences: array<struct<licence, dice, part>>, one entry for each line or paragraph that matches a template.

    A text's parts are its lines and, where a paragraph (between blank lines) has several lines, the paragraph. A part takes the
    template with the highest Dice coefficient 2|A and B| / (|A| + |B|), ties to the smaller name, if that is at least
    threshold. A part of a bigrams can only reach it with templates of a * t / (2 - t) to a * (2 - t) / t bigrams; others aren't
    compared, and a part that shares no bigram with any template is dropped first. Row-local, no shuffle.

    Null and empty texts, and parts of under two words, match nothing. Repeated rows are scanned one by one; a column named
    licences is replaced, others pass through.
    """
    named = [(n, b) for n, t in sorted((templates or TEMPLATES).items()) if (b := _template_bigrams(t))]
    every = F.array(*[F.lit(x) for x in sorted({x for _, b in named for x in b})])
    gate = _gate([b for _, b in named], threshold)
    smallest = min(len(b) for _, b in named)
    largest = max(len(b) for _, b in named)
    low, high = smallest * threshold / (2 - threshold), largest * (2 - threshold) / threshold
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    paragraphs = F.filter(F.split(t, r"\n[ \t\r]*\n\s*", -1), lambda p: F.contains(p, F.lit("\n")))
    parts = F.filter(F.concat(lines, paragraphs), lambda p: F.lower(p).rlike(gate))
    sized = F.filter(F.transform(parts, lambda p: F.struct(p.alias("part"), bigrams(p).alias("b"))), lambda s: F.size(s["b"]).between(low, high))

    def best(s: Column) -> Column:
        n = F.size(s["b"])
        dice = lambda b: F.when(
            n.between(len(b) * threshold / (2 - threshold), len(b) * (2 - threshold) / threshold),
            2.0 * F.size(F.array_intersect(s["b"], F.array(*[F.lit(x) for x in b]))) / (n + len(b)),
        ).otherwise(0.0)
        scores = F.array(*[F.struct((-dice(b)).alias("d"), F.lit(name).alias("licence")) for name, b in named])
        return let(F.array_min(scores), lambda m: F.struct(m["licence"].alias("licence"), (-m["d"]).alias("dice"), s["part"].alias("part")))

    shared = F.filter(sized, lambda s: F.arrays_overlap(s["b"], every))
    matches = F.filter(F.transform(shared, best), lambda m: m["dice"] >= threshold)
    return df.withColumn("licences", F.when(F.lower(t).rlike(gate), matches).otherwise(F.array().cast("array<struct<licence:string,dice:double,part:string>>")))


def licence_digest(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_matches, licences (distinct names, comma-joined), best_dice (null without a match)."""
    found = scan(df.select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.array_max(F.transform("licences", lambda m: m["dice"])).alias("best_dice"),
    )


def licence_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, over all pairs of parts and templates."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{x}'" for x in _template_bigrams(t))) for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH templates(name, tb) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, unnest(list_concat(string_split(t, chr(10)),
        list_filter(regexp_split_to_array(t, '\n[ \t\r]*\n\s*'), lambda x: contains(x, chr(10))))) AS part FROM d),
w AS (SELECT r, list_filter(regexp_split_to_array(lower(part), '[^a-z0-9]+'), lambda x: x <> '') AS w, row_number() OVER () AS id
      FROM p WHERE regexp_matches(part, '(?i)[a-z0-9][^a-z0-9]+[a-z0-9]')),
b AS (SELECT r, id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w
      WHERE len(w) >= 2),
s AS (SELECT r, id, name, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b, templates
      WHERE len(b) BETWEEN len(tb) * {threshold} / (2 - {threshold}) AND len(tb) * (2 - {threshold}) / {threshold}),
m AS (SELECT r, id, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM s WHERE dice >= {threshold} GROUP BY r, id),
g AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS best FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licences, best AS best_dice FROM d LEFT JOIN g USING (r)
"""
