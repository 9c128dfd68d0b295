"""Each licence's official notice is found as that licence."""

import pytest

from quartermill.llm import license_scan

CC = "This work is licensed under a Creative Commons Attribution{} License."
NOTICES = [
    ("cc-by", CC.format(" 4.0 International")), ("cc-by", CC.format(" 3.0 Unported")), ("cc-by", CC.format(" 4.0 International Public")),
    ("cc-by-sa", CC.format("-ShareAlike 4.0 International")), ("cc-by-sa", CC.format("-ShareAlike 3.0 Unported")), ("cc-by-sa", CC.format("-Share Alike 2.5 Generic")),
    ("cc-by-nc", CC.format("-NonCommercial 4.0 International")), ("cc-by-nc", CC.format("-Non-Commercial 3.0 Unported")),
    ("cc-by-nd", CC.format("-NoDerivatives 4.0 International")), ("cc-by-nd", CC.format("-NoDerivs 3.0 Unported")),
    ("cc-by-nc-sa", CC.format("-NonCommercial-ShareAlike 4.0 International")), ("cc-by-nc-nd", CC.format("-NonCommercial-NoDerivatives 4.0 International")),
    ("cc-by-sa", "Text under the CC BY-SA 4.0 license."), ("cc0", "CC0 1.0 Universal"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("agpl-3", "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "released under the BSD 3-Clause License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]


@pytest.mark.parametrize("label, text", NOTICES)
def test_official_notice(label, text):
    assert {x[2] for x in license_scan.matches(license_scan.words_of(text))[1]} == {label}

BODIES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL JANE ROE OR HER HEIRS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "gpl-3": "Frob is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. Frob is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize("label", BODIES)
def test_body_with_its_own_names(label):
    words = license_scan.words_of(BODIES[label])
    whole = [x for x in license_scan.matches(words)[1] if x[2] == label]
    assert max(end - start for start, end, *_ in whole) > 0.8 * len(words)
    changed = [w if w not in ("software", "source") else "thing" for w in words]  # mandatory wording must match exactly
    assert not any(end - start > 20 for start, end, *_ in license_scan.matches(changed)[1])


def test_identifiers_and_short_names():
    label = lambda t: {x[2:] for x in license_scan.matches(license_scan.words_of(t))[1]}
    assert label("# SPDX-License-Identifier: BSD-3-Clause") == {("bsd-3-clause", 0.8)}
    assert label("// SPDX-License-Identifier: GPL-2.0-or-later") == {("gpl-2", 0.8)}
    assert label("Licensed under CC BY-NC 4.0.") == {("cc-by-nc", 0.9)}
    assert label("Licensed under CC BY 4.0.") == {("cc-by", 0.9)}
    assert label("a license for the driver, and an SPDX document") == set()


def plain_matches(markup, words):
    """Every reading of a template, word by word, from every place; the longest match of each."""
    import re

    marks = [m for x in re.split(r"(\[\[|\]\]|\{\{\w+:\d+\}\})", markup) for m in ([x] if x[:2] in ("[[", "]]", "{{") else license_scan.words_of(x))]
    tree, stack = [], []
    here = tree
    for m in marks:
        if m == "[[":
            stack.append(here)
            here.append([])
            here = here[-1]
        elif m == "]]":
            here = stack.pop()
        else:
            here.append(m)

    def ends(nodes, at):
        found = {at}
        for node in nodes:
            if isinstance(node, list):
                found |= {e for f in found for e in ends(node, f)}
            elif node.startswith("{{"):
                found = {e for f in found for e in range(f, min(len(words), f + int(node[2:-2].split(":")[1])) + 1)}
            else:
                found = {f + 1 for f in found if f < len(words) and words[f] == node}
        return found

    return [(i, max(e)) for i in range(len(words)) if (e := ends(tree, i)) and max(e) > i]


def test_automata_equal_every_reading():
    import random

    from quartermill.llm.license_texts import templates

    rng = random.Random(31)
    every = list(templates())
    for _ in range(60):
        label, score, markup = rng.choice(every)
        words = license_scan.words_of(markup.replace("[[", " ").replace("]]", " ").replace("{{", " ").replace("}}", " "))
        words = [w for w in words if rng.random() > rng.choice((0.0, 0.02))] + [rng.choice(("license", "version", "2", "0", "cc", "by", "nc")) for _ in range(rng.randint(0, 6))]
        want = sorted((i, e, label, score) for i, e in plain_matches(markup, words))
        got = sorted(x for x in license_scan.matches(words)[1] if x[2:] == (label, score))
        assert set(want) <= set(got), (markup, words)
