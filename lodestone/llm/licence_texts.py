"""Licence phrases, names, notices and clauses that scans look for, as data; words are as ``licenses.words_of`` cuts them.

A name is found whole. Families of names (identifiers, versions, Creative Commons elements, ways to say that something is under a licence)
are put together by rule.
"""

from __future__ import annotations

from itertools import product

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Full names of licences, and their labels.
FULL_NAMES = {
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "gnu agpl": "agpl",
    "gnu free documentation license": "gfdl",
    "apache software license": "apache-software",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "2 clause bsd": "bsd-2-clause",
    "simplified bsd license": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "3 clause bsd": "bsd-3-clause",
    "new bsd license": "bsd-3-clause",
    "modified bsd license": "bsd-3-clause",
    "revised bsd license": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "european union public licence": "eupl",
    "european union public license": "eupl",
    "sil open font license": "ofl",
    "universal permissive license": "upl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open database license": "odbl",
    "community data license agreement": "cdla",
    "the unlicense": "unlicense",
    "unlicense org": "unlicense",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc0 universal": "cc0",
    "cc0 public domain dedication": "cc0",
    "publicdomain zero 1 0": "cc0",
}

#: Identifiers that name a licence wherever they stand.
IDENTIFIERS = {
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "lgpl 2 0": "lgpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl",
    "mpl 1 1": "mpl",
    "mpl 2 0": "mpl",
    "epl 1 0": "epl",
    "epl 2 0": "epl",
    "cddl 1 0": "cddl",
    "eupl 1 2": "eupl",
    "odbl 1 0": "odbl",
    "ofl 1 1": "ofl",
}
#: Identifiers that are other words, too, and so name a licence only after or before one of the words below.
SHORT = {
    "mit": "mit",
    "apache 2": "apache",
    "apache 2 0": "apache",
    "apache v2": "apache",
    "bsd": "bsd",
    "isc": "isc",
    "0bsd": "0bsd",
    "gpl": "gpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgpl": "lgpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agpl": "agpl",
    "agplv3": "agpl",
    "mpl": "mpl",
    "bsl 1 0": "bsl",
    "zlib": "zlib",
    "cc0": "cc0",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "artistic 2 0": "artistic",
}
#: What stands before or after such an identifier.
BEFORE = ("spdx license identifier", "license", "licence", "licensed under", "licensed under the", "released under", "released under the", "under the terms of the", "mit or", "apache 2 0 or")
AFTER = ("license", "licence", "licensed")
#: Families that are named with a version, and ways to write it.
VERSIONED = ("gpl", "lgpl", "agpl")
VERSIONS = ("v2", "v3", "version 2", "version 3")
#: Elements of Creative Commons licences after attribution, short and in the ways they are written out.
ELEMENTS = {
    "nc": ("noncommercial", "non commercial"),
    "sa": ("sharealike", "share alike"),
    "nd": ("noderivatives", "noderivs", "no derivatives"),
}
#: The elements of each Creative Commons licence.
COMMONS = (("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd"))


def names() -> dict[str, str]:
    """All names and their labels. Those of Creative Commons are ``cc-by`` and the licence's elements."""
    made = {**FULL_NAMES, **IDENTIFIERS}
    for name, label in SHORT.items():
        made.update({f"{x} {name}": label for x in BEFORE} | {f"{name} {x}": label for x in AFTER})
    made.update({f"{x} {v}": x for x, v in product(VERSIONED, VERSIONS)})
    for elements in COMMONS:
        label = "-".join(("cc-by", *elements))
        made["cc by " + " ".join(elements)] = label
        made["creativecommons org licenses by " + " ".join(elements)] = label
        for written in product(*[ELEMENTS[e] for e in elements]):
            made["creative commons attribution " + " ".join(written)] = label
    made["creativecommons org licenses by 4 0"] = made["creativecommons org licenses by 3 0"] = "cc-by"
    # The phrases that are counted have their labels by themselves.
    return {name: label for name, label in made.items() if name not in PHRASES}


_HOLDERS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {} General Public License for more details. You should have received a copy of the GNU {} General Public License "
    "along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_DEED = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)

#: Licence texts and notices, by label.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-text": _BSD + _HOLDERS,
    "bsd-3-text": _BSD + _BSD_THIRD + _HOLDERS,
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-notice": _NOTICE.format("", "3", "", ""),
    "lgpl-notice": _NOTICE.format("Lesser", "3", "Lesser", "Lesser"),
    "agpl-notice": _NOTICE.format("Affero", "3", "Affero", "Affero"),
    "mpl-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-notice": _DEED.format(""),
    "cc-by-sa-notice": _DEED.format("-ShareAlike"),
    "cc-by-nc-notice": _DEED.format("-NonCommercial"),
    "cc-by-nc-sa-notice": _DEED.format("-NonCommercial-ShareAlike"),
    "cc-by-nd-notice": _DEED.format("-NoDerivatives"),
    "cc-by-nc-nd-notice": _DEED.format("-NonCommercial-NoDerivatives"),
}

#: Clauses that only one family of licences has, by label; longer texts are known by any of theirs.
CLAUSES = {
    "mit-clause": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "apache-clause": (
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works "
        "in Source or Object form.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry "
        "prominent notices stating that You changed the files",
    ),
    "gpl-clause": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License "
        "is intended to guarantee your freedom to share and change free software",
    ),
    "zlib-clause": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions",
    ),
    "bsl-clause": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "unlicense-clause": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0-clause": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the "
        "work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "wtfpl-clause": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as "
        "the name is changed.",
    ),
}
#: Words that tell one template from its siblings. A span is a template's only with those of these words that the template has.
TELLING = "lesser affero library noncommercial sharealike noderivatives noderivs"
