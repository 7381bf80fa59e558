"""Wording of public licences as templates with markup.

<<beginOptional>> ... <<endOptional>> may be left out (regions nest); <<var;match=N>>
stands for at most N words of any kind (names, years, program titles). Everything
else is mandatory wording: it must be there word by word, in order. Case, punctuation
and line ends don't count. A label may have several templates.
"""

from __future__ import annotations

#: Phrases that every scan reports, with their labels. Fixed values.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

_OPT, _END = "<<beginOptional>>", "<<endOptional>>"
_COPYRIGHT = f"{_OPT} Copyright <<var;match=12>> {_OPT} All rights reserved. {_END} {_END}"

_AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=12>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:"""
_BSD_SOURCE = """<<var;match=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
_BSD_BINARY = """<<var;match=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var;match=1>> Neither the name of <<var;match=12>> nor the names of <<var;match=3>> contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<var;match=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=12>> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str) -> str:
    """The notice of a GNU licence in a file's head."""
    return f"""{_OPT} This <<var;match=4>> is free software {_END} you can redistribute it and/or modify it under the
terms of the GNU {kind} Public License as published by the Free Software Foundation {_OPT} either {_END} version {version}
{_OPT} of the License {_END} {_OPT} , or (at your option) any later version {_END}"""


def _named(kind: str, version: str) -> str:
    """A line that names a GNU licence and its version."""
    return f"""{_OPT} licensed under {_END} {_OPT} the {_END} {_OPT} terms of the {_END} GNU {kind} Public License {_OPT} as published by the Free Software
Foundation {_END} {_OPT} either {_END} version {version}"""


_VERSION = "".join(f"{_OPT} {v} {_OPT} 0 {_END} {_END} " for v in (4, 3, 2))


def _commons(kind: str, words: str) -> tuple[str, str]:
    """A line that names a Creative Commons licence, in full or by its letters."""
    full = f"licensed under {_OPT} a {_END} {_OPT} the {_END} Creative Commons {words} {_VERSION} {_OPT} International {_END} License"
    return full, f"licensed under {_OPT} a {_END} {_OPT} the {_END} {_OPT} Creative Commons {_END} CC {kind} {_VERSION} {_OPT} license {_END}"


#: (label, template).
TEMPLATES = (
    (
        "mit",
        f"""{_OPT} {_OPT} The {_END} MIT License {_OPT} (MIT) {_END} {_END} {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions: The above copyright notice and this permission notice {_OPT} (including the next paragraph) {_END}
shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}""",
    ),
    ("mit", f"{_OPT} released {_END} {_OPT} licensed {_END} {_OPT} distributed {_END} under {_OPT} the {_END} {_OPT} terms {_END} {_OPT} of {_END} the MIT {_OPT} Expat {_END} license"),
    ("bsd-2-clause", f"{_OPT} BSD 2-Clause License {_END} {_COPYRIGHT} {_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}"),
    ("bsd-3-clause", f"{_OPT} BSD 3-Clause License {_END} {_COPYRIGHT} {_BSD_HEAD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_AS_IS}"),
    (
        "isc",
        f"""{_OPT} ISC License {_END} {_COPYRIGHT} Permission to use, copy, modify, and{_OPT} /or {_END} distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        f"""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<var;match=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<var;match=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<var;match=1>> This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. {_OPT} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. {_END}""",
    ),
    (
        "apache-2",
        f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use {_OPT} this file {_END} {_OPT} these files {_END} except in
compliance with the License. You may obtain a copy of the License at {_OPT} http {_END} {_OPT} https {_END} {_OPT} www.apache.org/licenses/LICENSE-2.0
{_END} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    ),
    ("apache-2", f"{_OPT} licensed under {_END} {_OPT} the {_END} Apache {_OPT} Software {_END} License {_OPT} version {_END} 2 {_OPT} 0 {_END}"),
    (
        "mpl-2",
        f"""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at {_OPT} http {_END} {_OPT} https {_END} mozilla.org/MPL/2.0""",
    ),
    ("mpl-2", f"{_OPT} licensed under {_END} {_OPT} the {_END} Mozilla Public License {_OPT} version {_END} {_OPT} v {_END} 2 {_OPT} 0 {_END}"),
    ("boost-1", f"Distributed under the Boost Software License, Version 1.0 {_OPT} See accompanying file <<var;match=4>> {_END}"),
    ("gpl-2", _gnu("General", "2")),
    ("gpl-3", _gnu("General", "3")),
    ("lgpl-2.1", _gnu("Lesser General", "2.1")),
    ("lgpl-3", _gnu("Lesser General", "3")),
    ("agpl-3", _gnu("Affero General", "3")),
    ("gpl-2", _named("General", "2")),
    ("gpl-3", _named("General", "3")),
    ("lgpl-2.1", _named("Lesser General", "2.1")),
    ("lgpl-3", _named("Lesser General", "3")),
    ("agpl-3", _named("Affero General", "3")),
    *(("cc-by", t) for t in _commons("BY", "Attribution")),
    *(("cc-by-sa", t) for t in _commons("BY-SA", "Attribution-ShareAlike")),
    *(("cc-by-nc", t) for t in _commons("BY-NC", "Attribution-NonCommercial")),
    *(("cc-by-nd", t) for t in _commons("BY-ND", "Attribution-NoDerivatives")),
    *(("cc-by-nc-sa", t) for t in _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")),
    *(("cc-by-nc-nd", t) for t in _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")),
    ("cc0", f"{_OPT} dedicated to the public domain {_END} under {_OPT} the {_END} {_OPT} Creative Commons {_END} CC0 {_OPT} 1.0 {_END} {_OPT} Universal {_END}"),
)
