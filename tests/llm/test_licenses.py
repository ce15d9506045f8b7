import textwrap
import time

import pytest

from lodestar.llm import licenses, queries
from tests.llm.helpers import EDGE, docs, prose, table_rows

R = licenses.Recogniser()


def test_sentences():
    t = "One two. Version 2.0 is here! no\n\n...\nLast\nline, v. 2.0\n # \n# next\n"
    assert [t[a:b] for a, b in licenses.sentences(t)] == ["One two.", " Version 2.0 is here!", " no\n", "\nLast\nline, v. 2.0\n", " # \n# next\n"]
    assert licenses.sentences("") == licenses.sentences(" \n..\n") == []


# Public licence texts, each with words that the known sentences leave out.
WRAPPED = {
    "MIT": """MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
}


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [30, 80])
def test_wrapped_texts(sign, width):
    for name, text in WRAPPED.items():
        parts = [textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")]
        body = "\n\n".join(parts)
        wrapped = "".join(f"{sign}{line}\n" for line in body.split("\n"))
        before, after = "Some words before it\nwithout a stop\n\n", "\nWords after it"
        _, found = licenses.scan(before + wrapped + after, R)
        assert set(licenses.licences([x[2] for x in found])) == {name}, (name, found)
        for a, b, _ in found:
            inside = licenses.normalised((before + wrapped + after)[a:b])
            assert "words before" not in inside or sign == ""
            assert len(inside) < len(licenses.normalised(wrapped)) + 60


def test_many_sentences_take_linear_time():
    ids = ["MIT-GRANT"] * 30_000 + ["MIT-NOTICE", "AS-IS"] * 15_000
    started = time.time()
    assert licenses.licences(ids) == ["MIT"] * 30_000 and time.time() - started < 5


def test_rules_follow_the_order():
    assert licenses.licences(["MIT-GRANT", "MIT-NOTICE", "AS-IS"]) == ["MIT"]
    assert licenses.licences(["AS-IS", "MIT-GRANT"]) == ["MIT"]
    assert licenses.licences(["BSD-REDISTRIBUTE", "AS-IS", "BSD-ENDORSE"]) == ["BSD-3-Clause"]
    assert licenses.licences(["BSD-ENDORSE", "BSD-REDISTRIBUTE"]) == ["BSD-2-Clause"]
    assert licenses.licences(["GPL-FREE", "GPL-EITHER-2", "MIT-RELEASED"]) == ["GPL-2.0-or-later", "MIT"]
    assert licenses.licences([]) == []


def test_scan():
    for text, want in [
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("words before Licensed under CC BY-NC 4.0. words", ["CC-BY-NC-4.0"]),
        ("Released under the MIT License.\nAll rights reserved.", ["MIT", "Proprietary"]), ("the license is not under version control", []),
        ("LICENSED   under the\tGNU General Public License - version 3", ["GPL-3.0"]), ("unlicensed under cc by 4 0x", []),
        ("The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", ["MIT", "MIT"]),
    ]:
        assert licenses.licences([x[2] for x in licenses.scan(text, R)[1]]) == want, text


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_licenses(spark, sf).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary"}
    texts = table_rows(sf, "documents")
    assert len(rows) == len(texts)
    for d in texts:
        want = sorted(sum(([v] * d[1].count(k) for k, v in lines.items()), []))
        got = [x for x in rows[d[0]].licences.split(",") if x]
        assert sorted(got) == want, d[0]
        spans = [tuple(map(int, s.split(":"))) for s in rows[d[0]].spans.split(",") if s]
        assert all(any(k in d[1][a:b] for k in lines) for a, b in spans)


def test_edges(spark):
    rows = licenses.recognised(docs(spark, EDGE).selectExpr("*", "1 as spans", "2 as licences")).collect()
    assert len(rows) == len(EDGE) and all(r.licences == "" for r in rows)
    assert {r.doc_id: r.n_sentences for r in rows}[0] == 0
    assert licenses.recognised(docs(spark, [])).count() == 0
    long = prose(30000) + " Released under the MIT License. " + prose(10)
    assert [r.licences for r in licenses.recognised(docs(spark, [long, long])).collect()] == ["MIT", "MIT"]
