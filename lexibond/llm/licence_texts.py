"""Public licence texts, headers and names, as templates of the licence scan."""

#: Short licences in full, and of long ones the standard header and the head of the licence file.
TEXTS: dict[str, list[str]] = {
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "AGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
        You should have received a copy of the GNU Affero General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.
        <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
        allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
        specifically designed to ensure cooperation with the community in the case of network server software.""",
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
        DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
        Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that
        is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are
        controlled by, or are under common control with that entity.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED.""",
    ],
    "BSL-1.0": [
        """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following:""",
        """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        https://www.boost.org/LICENSE_1_0.txt)""",
    ],
    "CC-BY-4.0": [
        """Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and
        agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License ("Public
        License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration
        of Your acceptance of these terms and conditions.""",
    ],
    "CC-BY-NC-4.0": [
        """Creative Commons Attribution-NonCommercial 4.0 International Public License By exercising the Licensed Rights (defined below),
        You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International
        Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed
        Rights in consideration of Your acceptance of these terms and conditions.""",
    ],
    "CC-BY-SA-4.0": [
        """Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed Rights (defined below), You
        accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public
        License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights
        in consideration of Your acceptance of these terms and conditions.""",
    ],
    "CC0-1.0": [
        """CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive
        Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original
        work of authorship and/or a database (each, a "Work").""",
        """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to
        the public domain worldwide. This software is distributed without any warranty.""",
    ],
    "EPL-2.0": [
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0/""",
        """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE
        ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.""",
    ],
    "GPL-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth
        Floor, Boston, MA 02110-1301 USA.""",
        """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street,
        Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but
        changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.
        By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure
        the software is free for all its users.""",
    ],
    "GPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone
        is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU
        General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other
        practical works are designed to take away your freedom to share and change the works.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin
        Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license
        document, but changing it is not allowed. [This is the first released version of the Lesser GPL. It also counts as the successor
        of the GNU Library Public License, version 2, hence the version number 2.1.]""",
    ],
    "LGPL-3.0": [
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version
        of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License,
        supplemented by the additional permissions listed below.""",
    ],
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
        contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of
        others (if any) used by a Contributor and that particular Contributor's Contribution.""",
    ],
    "OFL-1.1": [
        """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available
        with a FAQ at: https://scripts.sil.org/OFL""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ],
    "WTFPL": [
        """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Copyright (C) 2004 Sam Hocevar <sam@hocevar.net> Everyone is
        permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the
        name is changed.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    ],
}

#: Names by which sentences call a licence.
NAMES: dict[str, list[str]] = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the AGPL-3.0 license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL-2.0 license"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL-3.0 license"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0"],
    "Zlib": ["the zlib License"],
}

#: How a sentence says that something has the licence of a name.
SAYINGS = ("Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}")


def templates() -> list[tuple[str, str, str]]:
    """``license, template, text``: the texts, each saying with each name, and SPDX tags with their usual endings."""
    out = [(k, f"{k}/text{i}", " ".join(t.split())) for k, v in TEXTS.items() for i, t in enumerate(v)]
    out += [(k, f"{k}/name{i}.{j}", s.format(t)) for k, v in NAMES.items() for i, t in enumerate(v) for j, s in enumerate(SAYINGS)]
    tags = [(k, e) for k in sorted({*TEXTS, *NAMES}) for e in (("", "-only", "-or-later") if "GPL" in k else ("",))]
    return out + [(k, f"{k}/tag{e}", f"SPDX-License-Identifier: {k}{e}") for k, e in tags]
