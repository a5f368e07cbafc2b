"""Texts of known licences and the short notices that stand for one (fixed values).

The folder ``licenses`` beside this file has complete texts as their publishers give them; ``--`` in a file name is ``:``.
"""

from __future__ import annotations

import re
from pathlib import Path

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_OWN_RISK = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_KEEP = "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"

LICENSES: dict[str, str] = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _OWN_RISK,
    "BSD-2-Clause": _BSD_HEAD + "\n" + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    + "derived from this software without specific prior written permission.\n\n"
    + _BSD_TAIL,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    + "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    + _OWN_RISK,
    "MIT": _GRANT + ", subject to the following conditions:" + _KEEP + _WARRANTY,
    "MIT-0": _GRANT + ".\n\n" + _WARRANTY,
    "MIT:titled": "MIT License\n\n" + _GRANT + ", subject to the following conditions:" + _KEEP + _WARRANTY,
    "MIT:notice": "Released under the MIT License.",
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    + "compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    + 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
    + "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    + "governing permissions and limitations under the License.",
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
    "WTFPL:terms": "0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    + "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
    + "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    + "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
    + "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    + "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    + "3. This notice may not be removed or altered from any source distribution.",
}

#: Headings that are often put over a text which has none of its own.
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License", "The ISC License"),
    "MIT": ("The MIT License", "The MIT License (MIT)"),
}
_END = "END OF TERMS AND CONDITIONS"


def _complete() -> dict[str, str]:
    """The texts of the folder, and the forms of them in which the appendix is left out or filled in."""
    found = {}
    for path in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        name, body = path.stem.replace("--", ":"), path.read_text(encoding="utf-8")
        found[name] = body
        if _END in body:
            terms = body[: body.index(_END)]
            found[f"{name}:terms"] = terms + _END
            found[f"{name}:terms without end"] = terms
        filled = re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", body)
        if filled != body:  # a copyright line that names someone is no part of the canonical text
            found[f"{name}:filled in"] = filled
    return found


LICENSES |= _complete()
LICENSES |= {f"{name}:title {k}": f"{title}\n\n{LICENSES[name]}" for name, titles in _TITLES.items() for k, title in enumerate(titles, 1)}
