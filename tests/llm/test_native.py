"""Licences and mixing: small cases, and DuckDB on edge cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import licenses, mixing


def same(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.execute(sql).df()
    norm = lambda d: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    return norm(got) == norm(want)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."),
        (2, mit),
        (3, None),
        (4, ""),
        (5, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
        (6, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (1, "permission to go"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    out = licenses.scan_licenses(docs)
    got = [(r["doc_id"], r["licenses"], r["unmatched"]) for r in out.collect()]
    assert (1, "MIT", "") in got and (2, "MIT", "") in got and (5, "Apache-2.0", "") in got
    assert (6, "", "mit_notice") in got and (7, "CC-BY-NC-4.0", "") in got and (3, "", "") in got
    assert same(spark, out, licenses.op4_sql(), documents=docs)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_wrapped_texts_gaps_and_tables(spark):
    mit = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction.
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software. All rights reserved. The software is provided "as is", without
# warranty of any kind."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice."""
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with\nthe License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
    long = "river mill " * 100_000 + "\nReleased under the MIT License"
    docs = spark.createDataFrame([(1, mit), (2, bsd), (3, apache), (4, "a line\nReleased under the MIT License\nanother line"), (5, long), (6, "it is dedicated to the\npublic domain")], "doc_id long, text string")
    out = licenses.scan_licenses(docs)
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in out.collect()}
    assert got == {1: ("MIT,Proprietary", ""), 2: ("BSD-2-Clause", ""), 3: ("Apache-2.0", ""), 4: ("MIT", ""), 5: ("MIT", ""), 6: ("CC0-1.0", "")}
    assert same(spark, out, licenses.op4_sql(), documents=docs)
    # Without gaps the shorter rule fits, and what stands behind the foreign sentence is left.
    assert {(r["licenses"], r["unmatched"]) for r in licenses.scan_licenses(docs, gap=0).collect() if r["doc_id"] == 1} == {("MIT,Proprietary", "as_is")}
    # Tables of a caller's own, thousands of them, and no stems.
    own = licenses.sentence_table(spark, [(f"s{k}", [f"known sentence number {k}", f"start of one {k} *"]) for k in range(3000)])
    rules = licenses.rule_table(spark, [("Two", ["s7", "s9"]), ("One", ["s9"])])
    text = spark.createDataFrame([(1, "Known sentence, number 7! Known sentence number 8. Start of one 9 and more."), (2, "known sentence number 9")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["licenses"], r["unmatched"]) for r in licenses.scan_licenses(text, own, rules).collect()) == [(1, "Two", "s8"), (2, "One", "")]


@pytest.fixture()
def corpus(spark):
    rows = [(i, "w " * (1 + (i * 7) % 40), f"s{i % 4}" if i % 11 else None) for i in range(300)]
    rows += [(900, None, "s1"), (901, "", "tiny"), (902, "a b c", "tiny"), (None, "x y", "s0"), (5, "w " * 36, "s1"), (5, "w " * 36, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_mix_meets_targets(spark, corpus):
    plan = mixing.plan_mix(corpus).collect()
    assert len(plan) == corpus.count()
    total = sum(r["size"] for r in plan)
    by = {}
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        assert all(0 <= p["position"] <= 1 for p in r["passes"])
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert all(abs(taken - target) <= 1 and target <= 3 * size + 1e-9 for taken, target, size in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    assert by["tiny"][1] == pytest.approx(3 * 3)
    drawn = mixing.draw(corpus).collect()
    assert [r["position"] for r in drawn] == sorted(r["position"] for r in drawn)
    assert sum(r["words"] for r in drawn) == sum(r["taken"] for r in plan)


def test_mix_agrees_with_duckdb(spark, corpus):
    first = F.round(F.element_at(F.transform("passes", lambda p: p["position"]), 1), 6)
    out = mixing.plan_mix(corpus).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.when(F.size("passes") > 0, first).alias("first_position"))
    assert same(spark, out.select(*[F.col(c).cast("double") for c in out.columns]), f"SELECT doc_id::DOUBLE AS doc_id, size::DOUBLE AS size, source_size::DOUBLE AS source_size, round(target, 4) AS target, taken::DOUBLE AS taken, first_position FROM ({mixing.op5_sql()})", documents=corpus)


def test_empty_mix(spark, corpus):
    assert mixing.plan_mix(corpus.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.plan_mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_schedule_inverts(spark):
    row = spark.range(1).select(F.array(*[F.lit(x) for x in (0.0, 2.0, 1.0)]).alias("p"))
    times = [0.0, 0.1, 0.4, 0.5, 0.7, 1.0]
    area = [t * t * 2 if t <= 0.5 else 0.5 + (2 * (t - 0.5) - (t - 0.5) ** 2) for t in times]
    got = row.select(*[mixing.invert_demand(F.lit(a), F.lit(area[-1]), F.col("p")).alias(f"t{k}") for k, a in enumerate(area)]).first()
    assert list(got) == pytest.approx(times, abs=1e-9)


NOTICES = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "GPL-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use.",
    "CC0-1.0": "This work is licensed CC0 1.0 Universal.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS WARRANTIES ARE DISCLAIMED.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.",
}


def test_notices_as_they_stand_in_files(spark):
    rows = [(k, text) for k, text in enumerate(NOTICES.values())] + [(99, "see no. 3 and sec. 4, v. 2 of it. " * 30_000 + NOTICES["MPL-2.0"]), (100, "Released under the MIT License. 2024 was a year.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.scan_licenses(docs)
    got = {r["doc_id"]: r["licenses"] for r in out.collect()}
    assert {name: got[k] for k, name in enumerate(NOTICES)} == {name: name for name in NOTICES}
    assert got[99] == "MPL-2.0" and got[100] == "MIT"
    assert same(spark, out, licenses.op4_sql(), documents=docs)
