"""Signature rules of the license scan.

A rule is a regular expression over a text's lower-cased words joined by one
space; it matches whole words. FAMILIES lists, for each label, the keyword that
gates its rules and the hand-written signatures, most specific first. Priority 1
is a notice or grant in full, 2 a license's name with its version, 3 a bare name
or address, 4 a clause that only hints at a license.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rank: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool


#: Contract phrases: fixed values.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

CONFIDENCE = {0: 1.0, 1: 0.95, 2: 0.9, 3: 0.75, 4: 0.5}

_V = "(?:version |v )?"
#: label -> keyword, ((priority, signature), ...)
FAMILIES: dict[str, tuple[str, tuple[tuple[int, str], ...]]] = {
    "MIT": ("mit license", ((1, "(?:licensed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of the )?mit license"), (1, "permission is hereby granted free of charge to any person obtaining a copy (?:[^ ]+ ){0,60}mit license"), (2, "the mit license mit"), (3, "mit license"))),
    "MIT-grant": ("permission is hereby granted", ((1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"), (4, "permission is hereby granted free of charge to any person"))),
    "X11": ("x11 license", ((1, "(?:licensed|released|distributed) under (?:the )?x11 license"), (2, "mit x11 license"), (3, "x11 license"))),
    "MIT-0": ("mit no attribution", ((2, "mit no attribution license"), (3, "mit no attribution"))),
    "Expat": ("expat license", ((1, "under (?:the )?expat license"), (3, "expat license"))),
    "Apache-2.0": ("apache license", ((1, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache license " + _V + "2(?: 0)?"), (2, "apache license " + _V + "2(?: 0)?"), (1, "unless required by applicable law or agreed to in writing (?:[^ ]+ ){0,40}apache license"))),
    "Apache-2.0-url": ("apache org licenses", ((2, "(?:http |https )?(?:www )?apache org licenses license 2 0(?: txt| html)?"), (3, "apache org licenses"))),
    "Apache-1.1": ("apache software license", ((2, "apache software license " + _V + "1 1"), (2, "apache software license " + _V + "1 0"), (3, "apache software license"))),
    "GPL-3.0": ("general public license", ((1, "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license " + _V + "3(?: 0)?"), (1, "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"), (2, "(?:gnu )?general public license " + _V + "3(?: 0)?(?: only| or later)?"), (2, "gnu general public license gpl " + _V + "3"))),
    "GPL-2.0": ("general public license", ((1, "(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license " + _V + "2(?: 0)?"), (1, "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"), (2, "(?:gnu )?general public license " + _V + "2(?: 0)?(?: only| or later)?"))),
    "GPL-1.0": ("general public license", ((2, "gnu general public license " + _V + "1(?: 0)?(?: only| or later)?"), (3, "gnu general public license"), (3, "terms of the general public license"))),
    "GPL-short": (" gpl", ((2, "gpl ?v?3(?: 0)?(?: only| or later| plus)?"), (2, "gpl ?v?2(?: 0)?(?: only| or later| plus)?"), (2, "gplv[23]"), (3, "licensed under (?:the )?gpl"), (3, "gnu gpl"))),
    "LGPL-3.0": ("lesser general public license", ((1, "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public license " + _V + "3(?: 0)?"), (2, "(?:gnu )?lesser general public license " + _V + "3(?: 0)?"))),
    "LGPL-2.1": ("lesser general public license", ((1, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"), (2, "(?:gnu )?lesser general public license " + _V + "2 1"), (3, "gnu lesser general public license"))),
    "LGPL-2.0": ("library general public license", ((2, "(?:gnu )?library general public license " + _V + "2(?: 0)?"), (3, "gnu library general public license"))),
    "LGPL-short": (" lgpl", ((2, "lgpl ?v?3(?: 0)?(?: only| or later)?"), (2, "lgpl ?v?2 ?1?(?: only| or later)?"), (3, "gnu lgpl"), (3, "lgpl"))),
    "AGPL-3.0": ("affero", ((1, "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu affero general public license " + _V + "3(?: 0)?"), (2, "(?:gnu )?affero general public license " + _V + "3(?: 0)?"), (3, "(?:gnu )?affero general public license"), (3, "affero gpl"))),
    "AGPL-short": (" agpl", ((2, "agpl ?v?3(?: 0)?(?: only| or later)?"), (3, "gnu agpl"))),
    "GFDL": ("free documentation license", ((1, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"), (2, "gnu free documentation license " + _V + "1 [123]"), (3, "(?:gnu )?free documentation license"))),
    "GPL-exception": ("exception", ((4, "gcc runtime library exception"), (4, "classpath exception"), (4, "bison exception"), (4, "openssl linking exception"), (4, "font embedding exception"), (4, "autoconf macro exception"))),
    "BSD-3-Clause": (" bsd", ((1, "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:3|three) clause bsd license"), (2, "bsd 3 clause(?: new or revised)?(?: license)?"), (2, "(?:new|modified|revised) bsd license"), (2, "3 clause bsd license"), (2, "three clause bsd(?: license)?"))),
    "BSD-2-Clause": ("bsd ", ((1, "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:2|two) clause bsd license"), (2, "bsd 2 clause(?: simplified)?(?: license)?"), (2, "simplified bsd license"), (2, "freebsd license"), (2, "2 clause bsd license"))),
    "BSD-4-Clause": (" bsd", ((2, "bsd 4 clause(?: license)?"), (2, "original bsd license"), (2, "4 clause bsd license"))),
    "BSD": (" bsd", ((1, "(?:licensed|released|distributed) under (?:the |a )?bsd (?:style )?license"), (3, "bsd (?:style )?license"), (3, "bsd licensed"))),
    "0BSD": ("bsd ", ((2, "bsd zero clause license"), (2, "0bsd license"))),
    "BSD-clauses": ("redistribution", ((1, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"), (4, "redistributions of source code must retain the above copyright notice"), (4, "redistributions in binary form must reproduce the above copyright notice"))),
    "BSD-noendorse": ("endorse or promote", ((4, "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"), (4, "may not be used to endorse or promote products derived from this software"))),
    "ISC": (" isc license", ((1, "(?:licensed|released|distributed) under (?:the )?isc license"), (3, "isc license"))),
    "ISC-grant": ("permission to use copy modify", ((1, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"), (4, "permission to use copy modify and distribute this software"))),
    "MPL-2.0": ("mozilla public license", ((1, "this source code form is subject to the terms of the mozilla public license v 2 0"), (2, "mozilla public license " + _V + "2(?: 0)?"), (2, "mozilla public license " + _V + "1 [01]"), (3, "mozilla public license"))),
    "MPL-short": (" mpl", ((2, "mpl ?v?2(?: 0)?"), (2, "mpl ?v?1 1"))),
    "EPL-2.0": ("eclipse public license", ((1, "this program and the accompanying materials are made available under the terms of the eclipse public license " + _V + "2(?: 0)?"), (2, "eclipse public license " + _V + "2(?: 0)?"), (2, "eclipse public license " + _V + "1(?: 0)?"), (3, "eclipse public license"))),
    "EDL": ("eclipse distribution license", ((2, "eclipse distribution license " + _V + "1(?: 0)?"), (3, "eclipse distribution license"))),
    "CDDL": ("common development and distribution license", ((2, "common development and distribution license " + _V + "1 [01]"), (3, "common development and distribution license"))),
    "CPL": ("common public license", ((2, "common public license " + _V + "1(?: 0)?"), (3, "common public license"))),
    "CPAL": ("common public attribution license", ((2, "common public attribution license " + _V + "1(?: 0)?"), (3, "common public attribution license"))),
    "EUPL": ("european union public licen", ((2, "european union public licen[cs]e " + _V + "1 [12]"), (3, "european union public licen[cs]e"))),
    "CECILL": ("cecill", ((2, "cecill free software license agreement"), (2, "cecill ?[bc]? " + _V + "[12](?: [01])?"), (3, "cecill ?[bc]? licen[cs]e"))),
    "Artistic": ("artistic license", ((2, "artistic license " + _V + "2(?: 0)?"), (2, "artistic license " + _V + "1(?: 0)?"), (2, "same terms as perl itself under the artistic license"), (3, "artistic license"))),
    "Perl": ("terms as perl", ((2, "same terms as perl(?: 5)?(?: itself)?"),)),
    "Zlib": ("zlib l", ((2, "zlib libpng license"), (3, "zlib license"))),
    "Zlib-grant": ("provided as is without any express", ((1, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"), (4, "provided as is without any express or implied warranty"))),
    "Libpng": ("libpng license", ((2, "libpng license version 2"), (3, "libpng license"))),
    "BSL-1.0": ("boost software license", ((1, "distributed under the boost software license " + _V + "1(?: 0)?"), (2, "boost software license " + _V + "1(?: 0)?"), (3, "boost software license"))),
    "Unlicense": ("unlicense", ((1, "this is free and unencumbered software released into the public domain (?:[^ ]+ ){0,200}unlicense"), (2, "the unlicense"), (3, "unlicense org"))),
    "Unlicense-text": ("unencumbered software", ((1, "this is free and unencumbered software released into the public domain"),)),
    "WTFPL": ("wtfpl", ((2, "wtfpl version 2"), (3, "wtfpl"))),
    "WTFPL-text": ("do what the fuck you want", ((1, "do what the fuck you want to public license"),)),
    "Public-domain": ("public domain", ((2, "(?:released|dedicated|placed) (?:in|into|to) the public domain"), (3, "this (?:work|file|software|code) is in the public domain"), (4, "public domain"))),
    "CC0-1.0": (" cc0", ((2, "cc0 1 0(?: universal)?(?: public domain dedication)?"), (3, "creative commons cc0"), (3, "cc0"))),
    "CC-url": ("creativecommons org", ((2, "creativecommons org licenses by nc nd [1-4] [05]"), (2, "creativecommons org licenses by nc sa [1-4] [05]"), (2, "creativecommons org licenses by nc [1-4] [05]"), (2, "creativecommons org licenses by nd [1-4] [05]"), (2, "creativecommons org licenses by sa [1-4] [05]"), (2, "creativecommons org licenses by [1-4] [05]"), (2, "creativecommons org publicdomain zero 1 0"))),
    "CC-BY-NC-ND": ("cc by", ((1, "(?:licensed|released|available) under (?:a |the )?cc by nc nd [1-4] [05]"), (2, "cc by nc nd(?: [1-4] [05])?"))),
    "CC-BY-NC-SA": ("cc by", ((1, "(?:licensed|released|available) under (?:a |the )?cc by nc sa [1-4] [05]"), (2, "cc by nc sa(?: [1-4] [05])?"))),
    "CC-BY-NC": ("cc by", ((1, "(?:licensed|released|available) under (?:a |the )?cc by nc [1-4] [05]"), (2, "cc by nc(?: [1-4] [05])?"))),
    "CC-BY-ND": ("cc by", ((2, "cc by nd(?: [1-4] [05])?"),)),
    "CC-BY-SA": ("cc by", ((1, "(?:licensed|released|available) under (?:a |the )?cc by sa [1-4] [05]"), (2, "cc by sa(?: [1-4] [05])?"))),
    "CC-BY": ("cc by", ((1, "(?:licensed|released|available) under (?:a |the )?cc by [1-4] [05]"), (2, "cc by [1-4] [05]"), (3, "cc by"))),
    "CC-name": ("creative commons", ((1, "licensed under a creative commons attribution noncommercial noderivatives [1-4] [05] (?:international|unported) license"), (1, "licensed under a creative commons attribution noncommercial sharealike [1-4] [05] (?:international|unported) license"), (1, "licensed under a creative commons attribution noncommercial [1-4] [05] (?:international|unported) license"), (1, "licensed under a creative commons attribution sharealike [1-4] [05] (?:international|unported) license"), (1, "licensed under a creative commons attribution noderivatives [1-4] [05] (?:international|unported) license"), (1, "licensed under a creative commons attribution [1-4] [05] (?:international|unported) license"), (2, "creative commons attribution(?: non ?commercial)?(?: share ?alike| no ?derivatives| no ?derivs)?(?: [1-4] [05])?"), (3, "creative commons licen[cs]e"))),
    "ODbL": ("open database license", ((2, "open (?:data commons )?open database license(?: v?1 0)?"), (3, "open database license"))),
    "ODC-BY": ("open data commons attribution", ((2, "open data commons attribution license(?: v?1 0)?"),)),
    "PDDL": ("open data commons public domain", ((2, "open data commons public domain dedication (?:and|amp) licen[cs]e(?: v?1 0)?"),)),
    "OGL-UK": ("open government licen", ((1, "contains public sector information licensed under the open government licence v[123](?: 0)?"), (2, "open government licence " + _V + "v?[123](?: 0)?"), (3, "open government licen[cs]e"))),
    "OFL-1.1": ("open font license", ((1, "this font software is licensed under the sil open font license version 1 1"), (2, "sil open font license " + _V + "1 [01]"), (3, "(?:sil )?open font license"))),
    "OFL-short": (" sil o", ((3, "sil ofl(?: 1 1)?"), (3, "sil org ofl"))),
    "PSF-2.0": ("python software foundation license", ((2, "python software foundation license " + _V + "2"), (3, "python software foundation license"))),
    "PSF-short": ("psf license", ((3, "psf license(?: agreement)?"),)),
    "PHP": ("php license", ((2, "php license " + _V + "3 0?1?"), (3, "php license"))),
    "Ruby": ("ruby license", ((2, "same terms as ruby under the ruby license"), (3, "ruby license"))),
    "OpenSSL": ("openssl", ((2, "dual openssl and ssleay license"), (3, "openssl license"))),
    "Vim": ("vim license", ((3, "vim license"),)),
    "Beerware": (" beer", ((2, "the beer ware license revision 42"), (3, "beerware license"), (3, "beer ware license"))),
    "JSON": ("good not evil", ((1, "the software shall be used for good not evil"),)),
    "W3C": (" w3c", ((2, "w3c software (?:and document )?notice and license"), (3, "w3c software license"), (3, "w3c document license"))),
    "Unicode": ("unicode license", ((2, "unicode license agreement data files and software"), (3, "unicode license(?: v?3)?"))),
    "NCSA": (" ncsa", ((2, "university of illinois ncsa open source license"), (3, "ncsa open source license"))),
    "AFL": ("academic free license", ((2, "academic free license " + _V + "[123] [01]"), (3, "academic free license"))),
    "OSL": ("open software license", ((2, "open software license " + _V + "[123] [01]"), (3, "open software license"))),
    "MS-PL": ("microsoft public license", ((2, "microsoft public license ms pl"), (3, "microsoft public license"))),
    "MS-RL": ("microsoft reciprocal license", ((2, "microsoft reciprocal license ms rl"), (3, "microsoft reciprocal license"))),
    "QPL": ("q public license", ((2, "q public license " + _V + "1(?: 0)?"), (3, "q public license"))),
    "LPPL": ("latex project public license", ((1, "this work may be distributed and or modified under the conditions of the latex project public license"), (2, "latex project public license " + _V + "1 [0-3]c?"), (3, "latex project public license"))),
    "PostgreSQL": ("postgresql licen", ((3, "postgresql licen[cs]e"),)),
    "UPL": ("universal permissive license", ((2, "universal permissive license " + _V + "1(?: 0)?"), (3, "universal permissive license"))),
    "MulanPSL": ("mulan p", ((2, "mulan psl ?v?2"), (2, "mulan permissive software license " + _V + "2"), (3, "mulan permissive software license"))),
    "BlueOak": ("blue oak", ((2, "blue oak model license(?: 1 0 0)?"),)),
    "Elastic-2.0": ("elastic license", ((2, "elastic license " + _V + "2(?: 0)?"), (3, "elastic license"))),
    "SSPL": ("server side public license", ((2, "server side public license " + _V + "1"), (3, "server side public license"))),
    "BUSL": ("business source license", ((2, "business source license " + _V + "1 1"), (3, "business source license"))),
    "RAIL": ("bigscience", ((2, "bigscience (?:open )?rail(?: m)? license"),)),
    "OpenRAIL": ("openrail", ((2, "openrail ?m? license"),)),
    "CreativeML": ("creativeml", ((2, "creativeml open ?rail m"),)),
    "Llama": ("community license agreement", ((2, "llama [23](?: [12])? community license agreement"), (3, "community license agreement"))),
    "ECL": ("educational community license", ((2, "educational community license " + _V + "[12](?: 0)?"), (3, "educational community license"))),
    "Sleepycat": ("sleepycat", ((3, "sleepycat license"),)),
    "ImageMagick": ("imagemagick license", ((3, "imagemagick license"),)),
    "curl": ("curl license", ((3, "curl license"),)),
    "FTL": ("freetype", ((2, "freetype project license"), (3, "freetype license"))),
    "IJG": ("independent jpeg group", ((2, "this software is based in part on the work of the independent jpeg group"), (3, "independent jpeg group license"))),
    "NASA": ("nasa open source agreement", ((2, "nasa open source agreement " + _V + "1 3"), (3, "nasa open source agreement"))),
    "CERN-OHL": ("cern open hardware licen", ((2, "cern open hardware licen[cs]e " + _V + "[12](?: [0-2])?(?: strongly reciprocal| weakly reciprocal| permissive)?"), (3, "cern open hardware licen[cs]e"))),
    "Copyleft-next": ("copyleft next", ((2, "copyleft next(?: 0 3 [01])?"),)),
    "Parity": ("parity public license", ((2, "parity public license(?: 7 0 0| 6 0 0)?"),)),
    "PolyForm": ("polyform", ((2, "polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license(?: 1 0 0)?"),)),
    "Commons-Clause": ("commons clause", ((2, "commons clause license condition v1 0"), (3, "commons clause"))),
    "All-rights": ("all rights reserved", ((3, "copyright (?:c )?(?:19|20)[0-9]{2} (?:[^ ]+ ){0,10}all rights reserved"), (4, "all rights reserved"))),
    "Proprietary": ("proprietary", ((3, "proprietary and confidential"), (3, "this (?:file|software|document) is proprietary"), (3, "unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,12}proprietary"))),
    "NonCommercial": ("commercial use", ((3, "for non ?commercial use only"), (3, "not for commercial use"), (4, "commercial use is (?:not permitted|prohibited|forbidden)"))),
    "Warranty": ("warrant", ((4, "without warranty of any kind express or implied"), (4, "without warranties or conditions of any kind"), (4, "but without any warranty without even the implied warranty of merchantability"), (4, "implied warranties of merchantability and fitness for a particular purpose"))),
    "Royalty-free": ("royalty free", ((4, "(?:perpetual|worldwide) (?:[^ ]+ ){0,6}royalty free (?:[^ ]+ ){0,4}licen[cs]e"), (4, "royalty free licen[cs]e"))),
    "Permission": ("with permission", ((4, "(?:used|reproduced|reprinted) with permission"),)),
}

#: Suffixes of labels that name a part of a family; they are not part of the label.
_PARTS = ("-grant", "-url", "-short", "-clauses", "-noendorse", "-name", "-text")
#: Identifiers named after "spdx license identifier", matched in their spoken form.
_SPDX = tuple(k for k in FAMILIES if not k.endswith(_PARTS))


def _label(family: str) -> str:
    for part in _PARTS:
        family = family.removesuffix(part)
    return family.lower()


def rules() -> list[Rule]:
    """Every rule, in order of rank."""
    out = [Rule(k, label, phrase, phrase, 0, CONFIDENCE[0], True) for k, (label, phrase) in enumerate(BASE)]
    for family, (keyword, signatures) in FAMILIES.items():
        for priority, pattern in signatures:
            out.append(Rule(len(out), _label(family), keyword, pattern, priority, CONFIDENCE[priority], False))
    for family in _SPDX:
        spoken = " ".join(family.lower().replace("-", " ").replace(".", " ").split())
        for pattern, priority in ((f"spdx license identifier {spoken}(?: only| or later)?", 1), (f"spdx identifier {spoken}", 2), (f"license {spoken}(?: only| or later)? spdx", 3)):
            out.append(Rule(len(out), _label(family), "spdx", pattern, priority, CONFIDENCE[priority], False))
    return out
