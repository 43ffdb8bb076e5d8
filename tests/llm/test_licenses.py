"""Published notices in their usual line breaks."""

import pytest

from tidemark.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.

"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products.

"""
NOTICES = {
    "GPL-3.0-or-later": GPL,
    "GPL-2.0-or-later": GPL.replace("software:", "software;").replace("version 3", "version 2"),
    "AGPL-3.0-or-later": GPL.replace("General", "Affero General"),
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "BSD-2-Clause": BSD2 + AS_IS,
    "BSD-3-Clause": BSD2 + THIRD + AS_IS,
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software, to deal in the Software without restriction,
subject to the following conditions:

The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""",
    "CC-BY-NC-4.0": """This work is licensed under a Creative Commons
Attribution-NonCommercial 4.0 International License.""",
    "CC-BY-NC-SA-3.0": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-SA-4.0": "The text is licensed under the Creative Commons Attribution-ShareAlike 4.0 License.",
    "CC-BY": "Licensed under CC BY.",
    "GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "BSD-3-Clause ": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX": "SPDX-License-Identifier: GPL-2.0-only OR MIT",
}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_wrapped_notices(spark, mark):
    names = list(NOTICES)
    rows = [(i, "\n".join((mark + line).rstrip() for line in NOTICES[n].split("\n"))) for i, n in enumerate(names)]
    rows.append((99, f"{mark}GPL, version 2\n\n{mark}This program is free software; you can redistribute it and/or modify it\n{mark}under the terms of the GNU General Public License.\n"))
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ([n.strip()], []) for i, n in enumerate(names)} | {99: (["GPL"], [])}


def test_unknown_sentences_are_reported(spark):
    text = "A fine program.\nThis program is licensed under the Foo license of 1999. All rights reserved. Nothing else."
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.unknown) for r in got} == {1: (["Proprietary"], ["this program is licensed under the foo license of 1999"]), 2: ([], []), 3: ([], [])}


def test_rules_against_plain_reading():
    """Every known sentence alone is found by its own identifier, or by an earlier one that says the same."""
    import re

    for i, (known, name) in enumerate(licenses.SENTENCES):
        said = " ".join("".join(c if c.isalnum() or c == "." else " " for c in known.replace("*", " some words ")).split())
        first = next(n for j, (k, n) in enumerate(licenses.SENTENCES) if re.search(licenses._pattern(k), f"| {said} |"))
        assert first == name or licenses.SENTENCES[[n for _, n in licenses.SENTENCES].index(first)][0].split("*")[0] in said, (i, known, first)
    assert all(any(n in rule for _, rule in licenses.RULES) or n.endswith(("_see", "_liable", "_as_is", "_copy", "_hope")) or n in ("bsd_endorse", "apache_comply", "apache_obtain", "mit_notice", "mpl_obtain") for _, n in licenses.SENTENCES)


def test_every_known_sentence_has_a_stem():
    import re

    for known, name in licenses.SENTENCES:
        assert re.search(licenses.HINT, known.replace("*", " ")), name
