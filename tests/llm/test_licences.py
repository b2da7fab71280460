from capforge.llm import licences as L

MIT = L.KNOWN["MIT"]


def scan(spark, frame, rows):
    return {r.doc_id: r for r in L.scan_licences(frame(rows), L.known_licences(spark)).collect()}


def test_equivalent_forms_match(spark, frame):
    rows = [(1, MIT), (2, "Copyright (c) 2019 Some One\n\n" + MIT.upper().replace(",", " ,")), (3, "© 2001-2004 A. Person. All rights reserved.\r\n" + MIT.replace("\n", "\r\n")),
            (4, MIT.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("sublicense", "sub-licence")), (5, MIT + " more"), (6, MIT.replace('"', "“"))]
    out = scan(spark, frame, rows)
    assert {i: out[i].licence for i in out} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "MIT"}


def test_lines_that_state_a_licence(spark, frame):
    out = scan(spark, frame, [(1, "some text\nReleased under the MIT licence!\nmore"), (2, "released under the mit license"), (3, "a released under the MIT License."),
                              (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.")])
    assert [(out[i].n_stated, out[i].first_stated) for i in (1, 2, 3, 4)] == [
        (1, "MIT (statement)"), (1, "MIT (statement)"), (0, None), (2, "CC-BY-NC-4.0 (statement)")]
    assert out[2].licence == "MIT (statement)"


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "... !!"), (4, "Copyright 2020 X"), (5, "copyright law in general"), (6, "word " * 60_000), (None, MIT), (None, MIT)]
    df = L.scan_licences(frame(rows), L.known_licences(spark))
    out = df.collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.canonical_sha256 is None} == {1, 2, 3, 4}
    assert sum(r.licence == "MIT" for r in out) == 2
    assert L.scan_licences(frame(rows).limit(0), L.known_licences(spark)).count() == 0


def test_known_licences_match_themselves(spark):
    forms = [r.f for r in L.known_licences(spark).select(L.joined(L.line_forms(L.F.col("text"))).alias("f")).collect()]
    assert len(set(forms)) == len(L.KNOWN) and all(forms)


def listed():
    return {x["licence"]: x for x in map(L.json.loads, L.pkgutil.get_data("capforge.llm", "licences.jsonl").decode().splitlines())}


def test_usual_files_of_the_table_match(spark, frame):
    data = listed()
    apache, gpl, bsd = (data[k]["texts"][0] for k in ("Apache-2.0", "GPL-3.0", "BSD-3-Clause"))
    rows = [(1, "MIT License\n\nCopyright (c) 2019 Jane Doe\n\n" + MIT), (2, "The MIT License (MIT)\nCopyright (c) 2019 Jane Doe\nAll rights reserved.\n" + MIT),
            (3, "Apache License\nVersion 2.0, January 2004\nhttps://www.apache.org/licenses/\n" + apache), (4, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + gpl),
            (5, "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + bsd), (6, data["Unlicense"]["texts"][0]), (7, apache + " more"),
            (8, "SPDX-License-Identifier: BSD-3-Clause\nThis work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.")]
    out = {r.doc_id: r for r in L.scan_licences(frame(rows), L.licence_table(spark)).collect()}
    assert {i: out[i].licence for i in out} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "GPL-3.0", 5: "BSD-3-Clause", 6: "Unlicense", 7: None, 8: None}
    assert (out[8].n_stated, out[8].first_stated) == (2, "BSD-3-Clause (statement)")


def test_a_form_names_one_licence(spark):
    table = L.licence_table(spark).select("licence", L.joined(L.line_forms(L.F.col("text"))).alias("form"))
    assert [r for r in table.groupBy("form").agg(L.F.collect_set("licence").alias("ids")).collect() if len(r.ids) > 1 or not r.form] == []
    assert {r.licence for r in table.collect()} >= set(L.KNOWN) | {k for k, x in listed().items() if x["texts"]}


def test_only_the_notice_is_left_out(spark, frame):
    line, long = " ".join(MIT.split()), "the quiet river runs past old stone houses and small green gardens where people talk about weather and bread " * 5
    rows = [(1, "Copyright (c) 2019 Jane Doe " + line), (2, "MIT License Copyright (c) 2019 Jane Doe. All rights reserved. " + line), (3, "(c) 1999 " + long), (4, long),
            (5, "Copyright 2020 X. Released under the MIT License."), (6, "© 2001-2004, 2006 Example Inc. and others. All rights reserved."),
            (7, "(c) 1999 Jane Doe. " + long), (8, "Copyright (c) 2019-present " + ", ".join(["Some One"] * 8) + " and contributors"),
            (9, "The MIT License (MIT) Copyright © 2019 Jane Doe " + line), (10, "COPYRIGHT (C) 2019 JANE DOE " + line.upper())]
    out = {r.doc_id: r for r in L.scan_licences(frame(rows), L.licence_table(spark)).collect()}
    assert [out[i].licence for i in (1, 2, 9, 10)] == ["MIT"] * 4
    assert out[3].canonical_sha256 == out[4].canonical_sha256 == out[7].canonical_sha256 is not None
    assert out[5].first_stated == "MIT (statement)"
    assert out[6].canonical_sha256 is None and out[8].canonical_sha256 is None
