"""Notices and key sentences of common licence families, as their publishers word them."""

# (family, text)
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-3.0", "Licensed under the GNU GPL v3."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("gpl-2.0", "Licensed under the GNU GPL v2."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "Released under the CC0 1.0 Universal public domain dedication."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced or distributed without the prior written permission of the publisher."),
]

# Sentences that use the same words and are no licence.
OTHER = [
    "He renewed his driving licence in the version of the form that the office gave him.",
    "The public was free to use the garden, and the general opened the work under the old gate.",
    "The software version was released under pressure, and the project was a success.",
    "Permission to enter the building is granted by the person at the desk.",
    "The holder of the record was named at the above event in April.",
    "They redistribute the food without restriction and free of charge to any person in need.",
    "The foundation published a report on the terms of trade and the conditions of work.",
    "An apache helicopter landed near the public domain of the university.",
    "The commons were open, and the creative work of the children was shown with attribution to each.",
    "All rights come with duties, and the reserved seats were at the front.",
]
