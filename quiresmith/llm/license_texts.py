"""Wordings of public licenses and of notices that grant them. Fixed values; ``<...>`` stands for any few words."""

_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(work: str, license_: str, version: str) -> str:
    """The notice that grants a GNU license or any later version."""
    return f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {license_} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


#: (SPDX identifier, name as written in notices)
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
)
#: Wordings that give an identifier or a name; by rule for each of them.
BY_IDENTIFIER = ("SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {} license.", "Released under the {} license.", "License: {}")
BY_NAME = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.")
#: Suffixes of GNU identifiers.
_SUFFIXES = ("", "-only", "-or-later")


#: (SPDX identifier, another name that it goes by in notices)
ALIASES: tuple[tuple[str, str], ...] = (
    *((f"{kind}-{v}", f"{short}{gap}v{v.removesuffix('.0')}") for kind, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",))) for v in versions for short in (kind, f"GNU {kind}") for gap in ("", " ")),
    *((i, name.replace(", version ", " v").replace(", Version ", " v")) for i, name in NAMES if "ersion " in name),
    *((i, name.replace(", version ", " ").replace(", Version ", " ")) for i, name in NAMES if "ersion " in name),
    ("Apache-2.0", "Apache 2.0"),
    ("MPL-2.0", "MPL 2.0"),
    ("PSF-2.0", "Python Software Foundation License"),
    ("PSF-2.0", "PSF License"),
    ("Artistic-2.0", "Artistic License 2.0"),
)
#: Addresses of license texts, without scheme, www and ending.
ADDRESSES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "apache.org/licenses/LICENSE-2.0"),
    ("MIT", "opensource.org/licenses/MIT"),
    ("MIT", "opensource.org/license/mit"),
    ("Apache-2.0", "opensource.org/licenses/Apache-2.0"),
    ("BSD-2-Clause", "opensource.org/licenses/BSD-2-Clause"),
    ("BSD-3-Clause", "opensource.org/licenses/BSD-3-Clause"),
    ("ISC", "opensource.org/licenses/ISC"),
    ("GPL-2.0", "gnu.org/licenses/gpl-2.0"),
    ("GPL-3.0", "gnu.org/licenses/gpl-3.0"),
    ("LGPL-3.0", "gnu.org/licenses/lgpl-3.0"),
    ("AGPL-3.0", "gnu.org/licenses/agpl-3.0"),
    ("MPL-2.0", "mozilla.org/MPL/2.0"),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    *((i, f"creativecommons.org/licenses/{i.removeprefix('CC-').removesuffix('-4.0').lower()}/4.0") for i, _ in NAMES if i.startswith("CC-")),
)


def _by_rule() -> tuple[tuple[str, str], ...]:
    """The wordings of all identifiers, names and other names."""
    ids = [(f"{i}{s}" if s == "-or-later" else i, f"{i}{s}") for i, _ in NAMES for s in (_SUFFIXES if "GPL" in i else _SUFFIXES[:1])]
    ids += [(i, i.replace("CC-", "CC ").replace("-4.0", " 4.0").replace("-1.0", " 1.0")) for i, _ in NAMES if i.startswith("CC-")]
    notices = [(i, w.format(shown)) for i, shown in ids for w in BY_IDENTIFIER]
    names = (*NAMES, *ALIASES)
    named = [*names, *((f"{i}-or-later", f"{name} or later") for i, name in names if "GPL" in i), *((f"{i}-or-later", f"{name}+") for i, name in ALIASES if "GPL" in i)]
    short = [(i, w.format(name)) for i, name in named if (i, name) not in NAMES for w in ("License: {}", "Licensed under {}.", "under the {} license")]
    return (*notices, *((i, w.format(name)) for i, name in named for w in (*BY_NAME, "under the terms of the {}")), *short)


def alternatives() -> tuple[tuple[str, str], ...]:
    """Identifiers and names as they stand after "or" and "and"."""
    ids = tuple((f"{i}{s}" if s == "-or-later" else i, f"{i}{s}") for i, _ in NAMES for s in (_SUFFIXES if "GPL" in i else _SUFFIXES[:1]))
    return (*ids, ("MIT", "MIT"), *NAMES, *ALIASES, *((f"{i}-or-later", f"{name} or later") for i, name in (*NAMES, *ALIASES) if "GPL" in i))


#: Titles of license texts, which count where they stand on a line of their own.
TITLES: tuple[tuple[str, str], ...] = (*NAMES, ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("MIT", "The MIT License (MIT)"))
#: (SPDX identifier, wording)
_WORDINGS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-or-later", _gnu("program", "General Public License", "2")),
    ("GPL-3.0-or-later", _gnu("program", "General Public License", "3")),
    ("LGPL-2.0-or-later", _gnu("library", "Library General Public License", "2")),
    ("LGPL-2.1-or-later", _gnu("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _gnu("library", "Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", _gnu("program", "Affero General Public License", "3")),
    ("LGPL-2.0", "This library is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    # The opening alone, which both have; a whole text saves more.
    ("BSD-2-Clause OR BSD-3-Clause", _BSD_CONDITIONS.split(" Redistributions in binary")[0]),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)
#: All wordings that are looked for, each once.
TEMPLATES: tuple[tuple[str, str], ...] = tuple(dict.fromkeys((*_WORDINGS, *_by_rule(), *ADDRESSES)))
