"""The wording of well-known public licences and of the notices that name them, by usual short names.

Words only: signs do not count for the scan, so they are left out, as are names and years.
"""

from __future__ import annotations

_GRANT_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify
merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
furnished to do so subject to the following conditions
"""
_NOTICE_MIT = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_NO_WARRANTY_MIT = """
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be
liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software
"""
_BSD_HEAD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met
"""
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = """
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution
"""
_BSD_NAMES = """
neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission
"""
_BSD_NO_WARRANTY = """
this software is provided by the copyright holders and contributors as is and any express or implied warranties including but
not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_ISC_GRANT = """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies
"""
_ISC_NO_WARRANTY = """
the software is provided as is and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this
software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be
plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered
from any source distribution
"""
_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by
any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright
interest in the software to the public domain we make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law
"""
_BOOST = """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to
prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to
the following
"""
_APACHE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license
"""
_GPL_3 = """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version 3 of the license or at your option any later version this program is
distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu
general public license along with this program if not see
"""
_LGPL = """
this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
as published by the free software foundation either version 2 1 of the license or at your option any later version this library
is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
or fitness for a particular purpose see the gnu lesser general public license for more details
"""
_AGPL = """
this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
as published by the free software foundation either version 3 of the license or at your option any later version
"""
_MPL = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
this file you can obtain one at http mozilla org mpl 2 0
"""

#: (label, wording): whole licences first, then the notices that name one.
LICENSES: tuple[tuple[str, str], ...] = (
    ("mit", _GRANT_MIT + _NOTICE_MIT + _NO_WARRANTY_MIT),
    ("mit", _GRANT_MIT),
    ("bsd", _BSD_HEAD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_NO_WARRANTY),
    ("bsd", _BSD_HEAD + _BSD_SOURCE + _BSD_BINARY),
    ("bsd", _BSD_HEAD),
    ("isc", _ISC_GRANT + _ISC_NO_WARRANTY),
    ("isc", _ISC_GRANT),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE),
    ("boost", _BOOST),
    ("apache", _APACHE),
    ("gpl", _GPL_3),
    ("lgpl", _LGPL),
    ("agpl", _AGPL),
    ("mpl", _MPL),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
)
