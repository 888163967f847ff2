"""Notices, grants and body paragraphs of public licences, by family, and notices of licences that are none of these."""

from __future__ import annotations

#: Public licence texts (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache License 2.0.",
        "Distributed under the terms of the Apache License, Version 2.0, January 2004.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This software is available under the terms of the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
        "Distributed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
        "Licensed under the ISC License.",
        "Released under the terms of the ISC License (ISC).",
        "SPDX-License-Identifier: ISC",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Released under the GNU General Public License v2.0.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "The contents of this file are subject to the Mozilla Public License",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, Version 2.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "Distributed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
        "Released under CC0 1.0 Universal.",
        "Licensed under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "Released under the Unlicense. For more information, please refer to https://unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
        "Content is available under CC BY 4.0 unless otherwise noted.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content is available under CC BY-NC 4.0 for noncommercial use only.",
        "Published under the Creative Commons Attribution-NonCommercial License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Content is available under CC BY-SA 3.0 unless otherwise noted.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
}

#: Sentences in the manner of a licence that name none of the families; examples of the unknown class.
STRANGERS: tuple[str, ...] = (
    "Licensed under the Business Source License 1.1.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This work is licensed under the European Union Public Licence, version 1.2.",
    "Released under the terms of the Artistic License 2.0.",
    "Licensed under the Microsoft Public License.",
    "This library is distributed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: Zlib",
    "Copyright by the authors. All rights reserved.",
    "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    "This software is licensed under the terms of the agreement between the parties.",
    "Use of this software is governed by the terms of your subscription agreement.",
    "The license of the driver was suspended for two years under the terms of the traffic law.",
    "The general public is free to use the library and its source materials.",
    "The council has granted a public license to the contractor, subject to the following conditions.",
    "Distribution of this document is unlimited.",
)

#: Names by which notices call the licences (fixed values).
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "MIT": ("MIT License", "MIT license terms", "MIT (Expat) License"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license"),
    "ISC": ("ISC License", "ISC license terms"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GNU General Public License"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "GNU LGPL", "GNU Lesser General Public License"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License", "Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License", "Eclipse Public License v1.0"),
    "CC0": ("CC0 1.0 Universal", "Creative Commons CC0 license", "CC0 1.0"),
    "Unlicense": ("Unlicense terms", "The Unlicense"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"),
}

#: Names of licences that are none of the families, and of things that are no licence.
STRANGE_NAMES: tuple[str, ...] = (
    "Boost Software License, Version 1.0", "Business Source License 1.1", "Artistic License 2.0", "SIL Open Font License, Version 1.1",
    "European Union Public Licence", "Microsoft Public License", "zlib license", "terms of your agreement", "License", "Public License",
    "General Public License", "terms of the contract", "license of the owner",
)

#: Phrases in which a licence is named.
CARRIERS: tuple[str, ...] = (
    "{}", "Licensed under the {}.", "Released under the {}.", "This project is released under the {}.", "This software is available under the terms of the {}.",
    "It is licensed under the {}.", "Distributed under the terms of the {}.", "See the {} for more details.", "Content is available under {} unless otherwise noted.",
    "This work is licensed under a {}.", "The code is covered by the {}.", "You may use it under the {}",
)
