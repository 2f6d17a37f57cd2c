"""Templates of licences: titles, SPDX names, customary short notices, file headers, full texts.

``notices`` has several short forms a licence, ``headers`` the paragraphs that
stand at the top of source files, ``full_texts`` the licences themselves. A notice that
names a family without a version goes to the family's name (``GPL``). The texts of
the Creative Commons licences (but CC0), EPL, EUPL and AGPL are not at hand: the
AGPL's is the GPL's with its own title, the others have notices and headers only.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

_FOLDER = Path(__file__).parent / "licenses"

# SPDX name -> titles under which a notice names the licence.
TITLES = {
    "MIT": ("MIT", "MIT/Expat", "Expat", "The MIT"),
    "Apache": ("Apache", "Apache Software"),
    "Apache-1.1": ("Apache Software, Version 1.1", "Apache 1.1"),
    "Apache-2.0": ("Apache, Version 2.0", "Apache 2.0", "Apache Software, Version 2.0", "Apache-2.0", "ASL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD", "BSD 3-Clause", "3-clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD-style", "BSD-3-Clause"),
    "BSD-4-Clause": ("BSD 4-Clause", "4-clause BSD", "Original BSD", "BSD-4-Clause"),
    "0BSD": ("Zero-Clause BSD", "0BSD"),
    "ISC": ("ISC",),
    "Zlib": ("zlib", "zlib/libpng"),
    "BSL-1.0": ("Boost Software", "Boost Software, Version 1.0", "BSL-1.0"),
    "Artistic-2.0": ("Artistic 2.0", "Artistic", "Artistic-2.0"),
    "PSF-2.0": ("Python Software Foundation", "PSF", "PSF-2.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public"),
    "MS-PL": ("Microsoft Public", "MS-PL"),
    "OFL-1.1": ("SIL Open Font", "SIL Open Font, Version 1.1", "OFL 1.1", "OFL-1.1"),
    "MPL": ("Mozilla Public", "MPL"),
    "EPL": ("Eclipse Public", "EPL"),
    "EUPL-1.2": ("European Union Public", "European Union Public, Version 1.2", "EUPL 1.2", "EUPL-1.2"),
    "CDDL-1.0": ("Common Development and Distribution", "CDDL 1.0", "CDDL-1.0"),
}
for _name, _long, _versions in (("MPL", "Mozilla Public", ("1.1", "2.0")), ("EPL", "Eclipse Public", ("1.0", "2.0")),):
    for _v in _versions:
        TITLES[f"{_name}-{_v}"] = (f"{_long}, Version {_v}", f"{_long} {_v}", f"{_name} {_v}", f"{_name}-{_v}")
for _name, _long, _versions in (("GPL", "General Public", ("2.0", "3.0")), ("LGPL", "Lesser General Public", ("2.1", "3.0")),
                                ("AGPL", "Affero General Public", ("3.0",)), ("GFDL", "Free Documentation", ("1.2", "1.3"))):
    TITLES[_name] = (f"GNU {_long}", f"{_name}", f"GNU {_name}")
    for _v in _versions:
        TITLES[f"{_name}-{_v}"] = (f"GNU {_long}, version {_v}", f"GNU {_long} {_v}", f"GNU {_long}, version {_v} or later",
                                   f"GNU {_long}, version {_v} only", f"{_name} {_v}", f"{_name} version {_v}", f"GNU {_name} {_v}",
                                   f"{_name}-{_v}-only", f"{_name}-{_v}-or-later", f"{_name} {_v} or later")
TITLES["LGPL-2.0"] = ("GNU Library General Public, version 2", "GNU Library General Public", "LGPL 2.0", "LGPL-2.0-only", "LGPL-2.0-or-later")

CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"": "", "1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

_FORMS = ("{0} License", "Licensed under the {0} License", "SPDX-License-Identifier: {0}")

OWN_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"), ("CC0-1.0", "Licensed under CC0"), ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "Licensed under CC0 1.0"), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("CC0-1.0", "Creative Commons Zero v1.0 Universal"),
    ("CC0-1.0", "http://creativecommons.org/publicdomain/zero/1.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
)


def _cc_notices() -> list[tuple[str, str]]:
    out = []
    for kind, words in CC_KINDS.items():
        for version, port in CC_VERSIONS.items():
            name = f"CC-{kind}-{version}" if version else f"CC-{kind}"
            short, long = f"CC {kind} {version}", f"Creative Commons {words} {version}"
            out += [(name, f.format(short)) for f in ("{0}", "Licensed under {0}", "SPDX-License-Identifier: {0}")]
            out += [(name, f.format(long, port)) for f in ("{0}", "Licensed under a {0} {1} License")]
            url = f"creativecommons.org/licenses/{kind.lower()}/{version}"
            out += [(name, f"http://{url}"), (name, f"This work is licensed under the {long} {port} License. To view a copy of this license, visit http://{url}/ "
                    "or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
                    (name, f"This is an open access article distributed under the terms of the {long} License ({short}), which permits use, distribution, "
                     "and reproduction in any medium, provided the original work is properly cited.")]
    return out


def notices() -> list[tuple[str, str]]:
    """(licence, short notice)."""
    out = [(name, form.format(title)) for name, titles in TITLES.items() for title in titles for form in _FORMS]
    return list(dict.fromkeys([*out, *OWN_NOTICES, *_cc_notices()]))


_GNU_END = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} License for more details.")
_GNU_COPY = "You should have received a copy of the GNU {1} License along with this {0}; if not, see <https://www.gnu.org/licenses/>."
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
           "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_END = ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
               "permissions and limitations under the License.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:")
_MIT_END = ('The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE '
            'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
            "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
         "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
         "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
         "documentation and/or other materials provided with the distribution.")
_BSD_AD = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
           "software developed by the organization.")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
             "software without specific prior written permission.")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
            "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
            "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
            "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
            "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.")
_ISC_END = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
            "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
              "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
         "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
         "it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
         "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
         "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
         "notice may not be removed or altered from any source distribution.")
_MPL2 = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
         "can obtain one at http://mozilla.org/MPL/2.0/.")
_EPL2 = ("This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which is available at "
         "https://www.eclipse.org/legal/epl-{0}")


def headers() -> list[tuple[str, str]]:
    """(licence, header): the first paragraph by itself and with what follows it."""
    out = [("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_END}"), ("MPL-2.0", _MPL2),
           ("EPL-1.0", _EPL2.format("1.0")), ("EPL-2.0", _EPL2.format("2.0"))]
    for name, long, versions in (("GPL", "General Public", ("2", "3")), ("LGPL", "Lesser General Public", ("2.1", "3")),
                                 ("AGPL", "Affero General Public", ("3",)), ("LGPL", "Library General Public", ("2",))):
        for v in versions:
            for what in ("program", "library"):
                for later in (f"either version {v} of the License, or (at your option) any later version", f"version {v} of the License",
                              f"version {v} only, as published by the Free Software Foundation"):
                    head = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {long} License as "
                            f"published by the Free Software Foundation, {later}.")
                    spdx = f"{name}-{v if '.' in v else v + '.0'}"
                    out += [(spdx, head), (spdx, f"{head} {_GNU_END.format(what, long)} {_GNU_COPY.format(what, long)}")]
    return out


def full_texts() -> list[tuple[str, str]]:
    """(licence, whole text)."""
    out = [("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_END}"), ("MIT", f"MIT License {_MIT} {_MIT_END}"),
           ("BSD-2-Clause", f"{_BSD2} {_BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License {_BSD2} {_BSD_END}"),
           ("BSD-3-Clause", f"{_BSD2} 3. {_BSD_NAME} {_BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License {_BSD2} 3. {_BSD_NAME} {_BSD_END}"),
           ("BSD-4-Clause", f"{_BSD2} {_BSD_AD} 4. {_BSD_NAME} {_BSD_END}"),
           ("ISC", _ISC), ("ISC", f"{_ISC} {_ISC_END}"), ("ISC", f"ISC License {_ISC} {_ISC_END}"),
           ("0BSD", f"{_ISC.split(', provided')[0]}. {_ISC_END}"), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB)]
    for path in sorted(_FOLDER.glob("*.txt")):
        out.append((path.stem, path.read_text(encoding="utf-8")))
    gpl = dict(out)["GPL-3.0"]
    affero = (gpl.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
              .replace("GNU GPL", "GNU AGPL").replace("29 June 2007", "19 November 2007"))
    out.append(("AGPL-3.0", affero))
    return out


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every form."""
    return tuple(dict.fromkeys([*notices(), *headers(), *full_texts()]))
