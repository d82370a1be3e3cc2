"""Licence wordings to look for.

Fixed values: the public texts of well-known licence grants and notices.
"""

#: (name, label, text)
TEMPLATES = (
    (
        "mit-grant",
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    ("mit-line", "mit", "Released under the MIT License."),
    (
        "apache-notice",
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    ("apache-line", "apache", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl-notice",
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    ("gpl-line", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "bsd-conditions",
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    (
        "isc-grant",
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mpl-notice",
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("cc-line", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-notice", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-line", "cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-notice", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-line", "cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-notice", "cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-line", "cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa-notice", "cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-line", "cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-nd-notice", "cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0-line", "cc0", "This work is licensed under CC0 1.0 Universal."),
    ("cc0-notice", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: By label: words a span must hold in the document, one of each group, before it gives the label.
NEEDED = {
    "cc-by-nc": (("noncommercial", "nc"),),
    "cc-by-sa": (("sharealike", "sa"),),
    "cc-by-nd": (("noderivatives", "noderivs", "nd"),),
    "cc-by-nc-sa": (("noncommercial", "nc"), ("sharealike", "sa")),
    "cc-by-nc-nd": (("noncommercial", "nc"), ("noderivatives", "noderivs", "nd")),
    "cc0": (("cc0", "waived"),),
}

#: (phrase, label): what counts as a mention by itself.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
