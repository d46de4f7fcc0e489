"""Wordings of public licences: notices, headers, titles and short texts, several forms a licence.

Words in braces identify the licence and must all be there; of the others a share may be missing.
Names and years of holders are left out of the texts.
"""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD_FIRST = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:"""
_BSD = _BSD_FIRST + """ 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or
{promote} products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the {Apache} License, Version {2.0} (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_MPL = """This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and {unencumbered} software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_CC0 = """To the extent possible under law, the author has {waived} all copyright and related or neighboring rights to
this work."""


def _named(*names: str) -> list[str]:
    """Notices that name the licence."""
    shapes = ("Licensed under the {} License.", "Licensed under the {}.", "Licensed under {}.", "Released under the {} License.",
              "Released under the {}.", "Released under {}.",
              "Distributed under the terms of the {} License.", "Distributed under the terms of the {}.", "License: {}",
              "This work is licensed under the {} License.")
    return [s.format(" ".join(f"{{{w}}}" for w in n.split())) for n in names for s in shapes]


def _gnu(kind: str, short: str, version: str, dated: str) -> list[str]:
    """Notices, header and title of a licence of the GNU family."""
    name = " ".join(f"{{{w}}}" for w in f"GNU {kind}General Public".split())
    v = f"{{{version}}}"
    numbers = {version, version.removesuffix(".0")}
    return [
        f"This work is licensed under the {name} License, version {v}.",
        f"Licensed under the {name} License, version {v}.",
        f"Licensed under the {name} License {{v{version}}}.",
        f"Licensed under the {name} License, version {v}, or any later version.",
        f"Licensed under version {v} of the {name} License.",
        f"it under the terms of the {name} License as published by the Free Software Foundation; either version {v} of the "
        "License, or (at your option) any later version.",
        f"it under the terms of the {name} License as published by the Free Software Foundation, version {v}.",
        f"it under the terms of the {name} License version {v} as published by the Free Software Foundation.",
        f"it under the terms of version {v} of the {name} License as published by the Free Software Foundation.",
        f"This software is distributed under the terms of the {name} License, version {v}.",
        f"{name} License Version {v}, {dated}",
        *(form for n in sorted(numbers) for form in _named(f"{short}v{n}", f"{short}-{n}", f"{short} v{n}", f"{short} version {n}", f"GNU {short}v{n}", f"GNU {short} v{n}")),
    ]


def _commons(code: str, title: str) -> list[str]:
    return [
        *_named(f"CC {code} 4.0", f"CC-{code}-4.0", f"Creative Commons {title} 4.0", f"Creative Commons {title} 4.0 International"),
        f"This work is licensed under a {{Creative}} {{Commons}} {{{title}}} {{4.0}} International License.",
        f"Creative Commons {{{title}}} {{4.0}} International Public License",
    ]


TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the {MIT} License.", "The {MIT} License ({MIT})", "{MIT} {License} {Copyright} (c)", _MIT, *_named("MIT", "Expat")],
    "Apache-2.0": [
        "Licensed under the {Apache} License, Version {2.0}.", "{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/",
        _APACHE, *_named("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0"),
    ],
    "GPL-3.0": _gnu("", "GPL", "3", "29 June 2007"),
    "GPL-2.0": _gnu("", "GPL", "2", "June 1991"),
    "LGPL-3.0": _gnu("Lesser ", "LGPL", "3", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser ", "LGPL", "2.1", "February 1999"),
    "AGPL-3.0": _gnu("Affero ", "AGPL", "3", "19 November 2007"),
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": [
        "Dedicated to the public domain under {CC0} {1.0} Universal.", "Creative Commons {CC0} {1.0} Universal", _CC0,
        *_named("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0"),
    ],
    "BSD": [_BSD_FIRST],  # the sentence that all of them begin with, where the clauses do not follow
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the {2-Clause} {BSD} License.",
        _BSD, *_named("2-Clause BSD", "BSD 2-Clause", "BSD-2-Clause", "Simplified BSD"),
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the {3-Clause} {BSD} License.",
        _BSD + _BSD3, *_named("3-Clause BSD", "BSD 3-Clause", "BSD-3-Clause", "New BSD", "Modified BSD"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}.", _MPL,
        "{Mozilla} Public License Version {2.0}", *_named("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0"),
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", _ISC, *_named("ISC")],
    "Unlicense": ["This is free and {unencumbered} software released into the public domain.", _UNLICENSE, *_named("Unlicense")],
}
