"""Wording of public licenses, with the words that tell versions and kin apart.

A key is the license and, after a hyphen, the kind of text (``-header``, ``-text``); other wordings of the
same follow after ``~``, and are reported without it. Long full texts lie beside the code in ``licenses``.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path
from typing import NamedTuple


class Template(NamedTuple):
    text: str
    #: All of these phrases must stand at the place found.
    needs: tuple[str, ...] = ()
    #: None of these may stand there.
    bars: tuple[str, ...] = ()


_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_FIRST = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_ADVERTISE = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_AGPL = (
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
    "distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft "
    "license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."
)
_EPL = (
    'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM '
    "CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
)
_WTFPL = (
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is "
    "changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
)
#: Phrases at the head of the full texts in the folder.
_TITLES = {
    "Apache-2.0": "version 2 0 january 2004", "Artistic-1.0-Perl": "artistic license", "CC0-1.0": "cc0 1 0 universal", "GFDL-1.2": "version 1 2 november 2002",
    "GFDL-1.3": "version 1 3 3 november 2008", "GPL-1.0": "general public license version 1 february 1989", "GPL-2.0": "general public license version 2 june 1991",
    "GPL-3.0": "gnu general public license version 3 29 june 2007", "LGPL-2.0": "library general public license version 2 june 1991",
    "LGPL-2.1": "lesser general public license version 2 1 february 1999", "LGPL-3.0": "lesser general public license version 3 29 june 2007",
    "MPL-1.1": "mozilla public license version 1 1", "MPL-2.0": "mozilla public license version 2 0",
}
#: Licenses named with a version: names, versions as (key, written).
_NAMED = [
    ("GPL", ("GNU General Public License", "GNU GPL", "GPL"), (("1.0", "1"), ("2.0", "2"), ("3.0", "3"))),
    ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"), (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3"))),
    ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), (("3.0", "3"),)),
    ("GFDL", ("GNU Free Documentation License",), (("1.1", "1.1"), ("1.2", "1.2"), ("1.3", "1.3"))),
    ("Apache", ("Apache License", "Apache Software License", "Apache"), (("1.0", "1.0"), ("1.1", "1.1"), ("2.0", "2.0"))),
    ("MPL", ("Mozilla Public License",), (("1.0", "1.0"), ("1.1", "1.1"), ("2.0", "2.0"))),
    ("EPL", ("Eclipse Public License",), (("1.0", "1.0"), ("2.0", "2.0"))),
    ("CDDL", ("Common Development and Distribution License",), (("1.0", "1.0"), ("1.1", "1.1"))),
    ("EUPL", ("European Union Public Licence", "European Union Public License"), (("1.1", "1.1"), ("1.2", "1.2"))),
    ("BSL", ("Boost Software License",), (("1.0", "1.0"),)),
    ("Artistic", ("Artistic License",), (("1.0", "1.0"), ("2.0", "2.0"))),
]
#: Licenses whose name says all.
_PLAIN = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Zlib": ("zlib License",), "Unlicense": ("The Unlicense License", "Unlicense License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _header(kind: str, name: str, comma: str, version: str) -> str:
    return (
        f"This {kind} is free software{comma} you can redistribute it and/or modify it under the terms of the {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


@cache
def licenses() -> dict[str, Template]:
    """All templates by key. Reads the full texts, so call it where the package lies as files: on the driver."""
    found: dict[str, Template] = {}

    def add(key: str, text: str, needs: tuple[str, ...] = (), bars: tuple[str, ...] = ()) -> None:
        n = sum(k.split("~")[0] == key for k in found)
        found[f"{key}~{n}" if n else key] = Template(text, needs, bars)

    for family, names, versions in _NAMED:
        for key, version in versions:
            for name in names:
                said = name.split(" ", 1)[1] if name.startswith("GNU ") else name
                short, full = version.removesuffix(".0"), version if "." in version else f"{version}.0"
                for form in dict.fromkeys(word + v for word in ("version ", "v", "") for v in (short, full)):
                    # A version that goes on, as 2.1 does, is another one.
                    bars = tuple(f"{said} {form}.{d}" for d in range(1, 10)) if "." not in form else ()
                    add(f"{family}-{key}", f"Licensed under the {name}, {form}", (f"{name} {form}",), bars)
                    add(f"{family}-{key}", f"Released under the {name}, {form}", (f"{name} {form}",), bars)
                    add(f"{family}-{key}", f"Distributed under the {name}, {form}", (f"{name} {form}",), bars)
                    add(f"{family}-{key}", f"This work is licensed under the {name}, {form}.", (f"{name} {form}",), bars)
                    add(f"{family}-{key}", f"under the terms of the {name}, {form}", (f"{name} {form}",), bars)
    for key, names in _PLAIN.items():
        for name in names:
            for verb in ("Released", "Licensed", "Distributed", "available"):
                add(key, f"{verb} under the {name}", (f"under the {name}",))
            add(key, f"under the terms of the {name}", (name,))
    for code, name in _CC.items():
        for version, suffix in _CC_VERSIONS.items():
            key = f"CC-{code}-{version}"
            for verb in ("Licensed", "Released"):
                add(key, f"{verb} under CC {code} {version}.", (f"cc {code} {version}",))
            for start in ("This work is licensed under a", "Licensed under a", "Licensed under the", "Released under a"):
                add(key, f"{start} Creative Commons {name} {version} {suffix} License.", (f"{name} {version}",))
                add(key, f"{start} Creative Commons {name} {version} License.", (f"{name} {version}",))
    for start in ("Released under", "Licensed under", "dedicated to the public domain under"):
        add("CC0-1.0", f"{start} the Creative Commons CC0 1.0 Universal", ("cc0 1.0",))
        add("CC0-1.0", f"{start} CC0 1.0 Universal", ("cc0 1.0",))
    for version, written in (("1.0", "1"), ("2.0", "2"), ("3.0", "3")):
        add(f"GPL-{version}-header", _header("program", "GNU General Public License", ":", written), ("gnu general public license", f"either version {written} of"))
        add(
            f"GPL-{version}-only-header",
            f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {written} as published by the Free Software Foundation.",
            (f"gnu general public license version {written}",),
        )
        add(
            f"GPL-{version}-only-header",
            f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version {written} of the License.",
            ("gnu general public license", f"foundation version {written} of"),
        )
    for version, written in (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3")):
        for name in ("GNU Lesser General Public License", "GNU Library General Public License"):
            for kind in ("library", "program"):
                add(f"LGPL-{version}-header", _header(kind, name, ";", written), (name, f"either version {written} of"))
    add("AGPL-3.0-header", _header("program", "GNU Affero General Public License", ":", "3"), ("gnu affero general public license", "either version 3 of"))
    add("AGPL-3.0-text", _AGPL, ("gnu affero general public license version 3",))
    add("Apache-2.0-header", _APACHE, ("apache license version 2.0",))
    add("MIT-text", f"{_MIT}, subject to the following conditions:", ("subject to the following conditions",))
    add("MIT-text", f"{_MIT}, subject to the following conditions: {_MIT_NOTICE}", (_MIT_NOTICE[:40].rsplit(" ", 1)[0],))
    add("MIT-0-text", f'{_MIT}. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', ("to do so the software is provided",), ("subject to the following conditions",))
    add("BSD-2-Clause-text", _FIRST + _DISCLAIMER, ("provided with the distribution",), ("endorse or promote", "all advertising materials"))
    add("BSD-3-Clause-text", f"{_FIRST}3. {_NAMES}{_DISCLAIMER}", ("endorse or promote",), ("all advertising materials",))
    add("BSD-4-Clause-text", f"{_FIRST}{_ADVERTISE}4. {_NAMES}{_DISCLAIMER}", ("all advertising materials", "endorse or promote"))
    for permit in (_PERMIT, _PERMIT.replace("and/or", "and")):
        add("ISC-text", f"{permit}, provided that the above copyright notice and this permission notice appear in all copies.{_AS_IS}", ("provided that the above copyright notice",))
        add("0BSD-text", f"{permit}.{_AS_IS}", ("is hereby granted the software is",), ("provided that the above copyright notice",))
    add("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v. 2.0",))
    add("MPL-1.1-header", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", ("mozilla public license version 1.1",))
    add("EPL-2.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2.0",))
    add("EPL-2.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", ("eclipse public license v2.0",))
    add("EPL-1.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ("eclipse public license v1.0",))
    for version in ("1.0", "2.0"):
        add(f"EPL-{version}-text", f"Eclipse Public License - v {version} {_EPL}", (f"eclipse public license v {version}",))
    add("BSL-1.0-text", _BSL)
    add("Zlib-text", _ZLIB)
    add("Unlicense-text", _UNLICENSE)
    add("Unlicense-text", "This is free and unencumbered software released into the public domain.")
    add("WTFPL-2.0-text", _WTFPL)
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        add(file.stem, file.read_text(encoding="utf-8"), (_TITLES[file.stem.removesuffix("-text")],))
    return found
