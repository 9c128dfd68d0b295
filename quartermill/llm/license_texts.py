"""Wording of licenses in template markup: bodies, the notices they ask for, and short names.

Fixed values: the wording is the licenses' own. [[ ]] may be missing, {{name:n}} stands for any words, n at most. Punctuation and
case don't count. Families that differ by a version or a condition are written by a rule.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

AS_IS = """in no event shall {{holders:10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not
limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
WARRANTIES = """This software is provided by {{holders:10}} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of
merchantability and fitness for a particular purpose are disclaimed."""

#: Whole texts, or all of their operative wording.
BODIES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice [[including the next paragraph]] shall be included in all copies or substantial portions of the Software. The software is provided "as is", without warranty of
any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall
{{holders:8}} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the
software or the use or other dealings in the software."""),
    ("bsd-2-clause", f"{REDISTRIBUTION} {WARRANTIES} {AS_IS}"),
    ("bsd-3-clause", f"""{REDISTRIBUTION} [[3]] Neither the name of {{{{holder:10}}}} nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. {WARRANTIES} {AS_IS}"""),
    ("isc", """Permission to use, copy, modify, and [[or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. The software is provided "as is" and {{author:6}} disclaims all warranties with regard to this software including
all implied warranties of merchantability and fitness. In no event shall {{author:6}} be liable for any special, direct, indirect, or consequential damages or any damages
whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the
use or performance of this software."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any source distribution."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above
license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at {{address:8}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at {{address:6}}"""),
)

#: Notices in a sentence.
NOTICES = (
    ("mit", "under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("apache-2", "apache license version 2 0"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("lgpl", "gnu lesser general public license [[as published by the free software foundation]] [[either]] version {{number:2}}"),
    ("agpl-3", "gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "under the [[terms of the]] bsd [[2 clause]] [[3 clause]] license"),
    ("mpl-2", "mozilla public license [[v]] [[version]] 2 0"),
    ("cc0", "cc0 1 0 universal"),
    ("cc0", "to the extent possible under law {{author:8}} waived all copyright and related or neighboring rights to"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("all-rights-reserved", "all rights reserved [[by {{holder:4}}]] [[no part of this {{work:2}} may be reproduced]]"),
)

#: Identifiers that follow "SPDX-License-Identifier:".
IDENTIFIERS = (
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("isc", "ISC"), ("zlib", "Zlib"), ("bsl-1", "BSL-1.0"),
    ("gpl-2", "GPL-2.0 [[only]] [[or later]]"), ("gpl-3", "GPL-3.0 [[only]] [[or later]]"), ("lgpl", "LGPL-2.1 [[only]] [[or later]]"), ("lgpl", "LGPL-3.0 [[only]] [[or later]]"),
    ("agpl-3", "AGPL-3.0 [[only]] [[or later]]"), ("mpl-2", "MPL-2.0"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0"), ("wtfpl", "WTFPL"),
)


def gnu_headers() -> Iterator[tuple[str, str]]:
    """The header of each GNU licence's files."""
    for label, kind, version in (("gpl-2", "", "2"), ("gpl-3", "", "3"), ("lgpl", "Lesser", "2.1"), ("lgpl", "Lesser", "3"), ("agpl-3", "Affero", "3")):
        yield label, f"""{{{{work:3}}}} is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. {{{{work:3}}}} is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details."""


def creative_commons() -> Iterator[tuple[str, str]]:
    """The six licences by their names, in one word or two, and by their short names with a version."""
    wording = {"nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"), "nd": ("noderivatives", "no derivatives", "noderivs", "no derivs")}
    versions = ("1 0", "2 0", "2 5", "3 0", "4 0")
    optional = " ".join(f"[[{v}]]" for v in versions) + " [[generic]] [[unported]] [[international]] [[public]]"
    for parts in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        label = "-".join(("cc-by", *parts))
        for words in itertools.product(*(wording[p] for p in parts)):
            yield label, " ".join(("creative commons attribution", *words, optional, "license"))
        yield label, " ".join(("cc by", *parts, optional, "license"))
        for v in versions:
            yield label, " ".join(("cc by", *parts, v))


def templates() -> Iterator[tuple[str, float, str]]:
    """(label, score, markup): 1 for wording that leaves no doubt, less for a name or an identifier."""
    for label, markup in (*BODIES, *gnu_headers(), *NOTICES):
        yield label, 1.0, markup
    for label, markup in creative_commons():
        yield label, 0.9, markup
    for label, name in IDENTIFIERS:
        yield label, 0.8, f"spdx license identifier {name}"
