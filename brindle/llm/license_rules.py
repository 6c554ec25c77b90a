"""Signature rules of the license scan: label, rank, keyword and regex over normalised words.

Normalised text has lower-case words of ASCII letters, digits and non-ASCII characters with one space between them, so
"GPL-3.0+" reads "gpl 3 0". Ranks: 3 a license's own name with its version or a unique sentence, 2 its name, 1 a family
or a usual sentence, 0 a vague hint. The keyword is a plain string that every match of the regex contains.
"""

from __future__ import annotations

VER = r"(?: v| ver| version)?"
#: label | rank | keyword | regex
WRITTEN = r"""
gpl-3.0-or-later|3|general public license|gnu general public license(?: as published by the free software foundation)? (?:either )?version 3 or (?:at your option )?any later version
gpl-2.0-or-later|3|general public license|gnu general public license(?: as published by the free software foundation)? (?:either )?version 2(?: of the license)? or (?:at your option )?any later version
gpl|2|general public license|gnu general public license
gpl|2|general public licence|gnu general public licence
gpl|1|gnu gpl|gnu gpl
gpl|1|gpl|(?:under|the) (?:the )?gpl
lgpl|2|lesser general public license|gnu lesser general public license
lgpl|2|library general public license|gnu library general public license
lgpl|1|lgpl|(?:under|the|gnu) (?:the )?lgpl
agpl|2|affero general public license|(?:gnu )?affero general public license
agpl|1|agpl|(?:under|the|gnu) (?:the )?agpl
gfdl|2|free documentation license|gnu free documentation license
gfdl|1|gfdl|(?:under|the|gnu) (?:the )?gfdl
gpl-classpath|3|classpath exception|(?:with )?(?:the )?(?:gnu )?classpath exception
gpl-font|3|font exception|with (?:the )?font exception
gpl-linking|3|linking exception|(?:with )?(?:the )?(?:static )?linking exception
apache-2.0|3|licensed under the apache license|licensed under the apache license(?: version)? 2 0
apache-2.0|3|apache license|apache license(?: v| version)? ?2(?: 0)?
apache-2.0|3|apache 2|apache 2 0 license
apache-2.0|3|apache org licenses license 2 0|(?:http|https) www apache org licenses license 2 0
apache-1.1|3|apache software license|apache software license version 1 1
apache-1.1|3|apache license|apache license(?: v| version)? 1 1
apache-1.0|3|apache license|apache license(?: v| version)? 1 0
apache|2|apache license|apache license
apache|2|apache software license|apache software license
mit|3|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|2|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy
mit|2|mit license|(?:the )?mit license
mit|2|mit licence|(?:the )?mit licence
mit|2|released under the mit|released under the mit(?: license)?
mit|1|mit licensed|mit licensed
mit-0|3|mit no attribution|mit no attribution
mit|3|expat license|(?:the )?expat license
x11|2|x11 license|(?:the )?x11 license
x11|2|x consortium|x consortium license
isc|3|permission to use copy modify and or distribute|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|2|isc license|(?:the )?isc license
bsd-4-clause|3|advertising materials mentioning|all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clause|3|neither the name|neither the name of (?:(?!nor the names of its contributors may |neither the name |may be used )[^ ]+ )++nor the names of its contributors may be used to endorse or promote products
bsd|2|redistribution and use in source and binary forms|redistribution and use in source and binary forms with or without modification are permitted
bsd-0-clause|3|zero clause bsd|zero clause bsd(?: license)?
bsd-0-clause|3|0bsd|0bsd
bsd-2-clause|3|simplified bsd|simplified bsd license
bsd-2-clause|3|freebsd license|freebsd license
bsd-2-clause|3|bsd 2 clause|bsd 2 clause(?: license)?
bsd-2-clause|3|2 clause bsd|2 clause bsd(?: license)?
bsd-3-clause|3|new bsd license|new bsd license
bsd-3-clause|3|modified bsd license|modified bsd license
bsd-3-clause|3|revised bsd license|revised bsd license
bsd-3-clause|3|bsd 3 clause|bsd 3 clause(?: license)?
bsd-3-clause|3|3 clause bsd|3 clause bsd(?: license)?
bsd-4-clause|3|original bsd license|original bsd license
bsd|2|bsd license|(?:the )?bsd license
bsd|1|bsd style|bsd style license
zlib|3|provided as is without any express or implied|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|2|zlib license|(?:the )?zlib license
zlib|2|zlib libpng|zlib libpng license
libpng|2|libpng license|(?:the )?libpng license
boost|3|boost software license|boost software license version 1 0
boost|2|boost software license|boost software license
unlicense|3|free and unencumbered software|this is free and unencumbered software released into the public domain
unlicense|2|unlicense|(?:the )?unlicense
wtfpl|3|do what the|do what the f\S+ you want to public license
wtfpl|2|wtfpl|wtfpl
mpl-2.0|3|mozilla public license|mozilla public license(?: v| version)? 2 0
mpl-1.1|3|mozilla public license|mozilla public license(?: v| version)? 1 1
mpl-1.0|3|mozilla public license|mozilla public license(?: v| version)? 1 0
mpl|2|mozilla public license|mozilla public license
npl|2|netscape public license|netscape public license
epl-2.0|3|eclipse public license|eclipse public license(?: v| version)? 2 0
epl-1.0|3|eclipse public license|eclipse public license(?: v| version)? 1 0
epl|2|eclipse public license|eclipse public license
edl-1.0|3|eclipse distribution license|eclipse distribution license(?: v| version)? 1 0
cpl|2|common public license|common public license(?: v| version)?(?: 1 0)?
ipl|2|ibm public license|ibm public license(?: v| version)?(?: 1 0)?
cddl-1.1|3|common development and distribution license|common development and distribution license(?: v| version)? 1 1
cddl-1.0|3|common development and distribution license|common development and distribution license(?: v| version)? 1 0
cddl|2|common development and distribution license|common development and distribution license
cddl|1|cddl|(?:under|the) (?:the )?cddl
cpal|2|common public attribution license|common public attribution license
eupl-1.2|3|european union public|european union public licen[cs]e(?: v| version)? 1 2
eupl-1.1|3|european union public|european union public licen[cs]e(?: v| version)? 1 1
eupl|2|european union public|european union public licen[cs]e
eupl|1|eupl|eupl
cecill-b|3|cecill b|cecill b(?: license)?
cecill-c|3|cecill c|cecill c(?: license)?
cecill|2|cecill|cecill(?: license)?
artistic-2.0|3|artistic license|artistic license(?: v| version)? 2 0
artistic-1.0|3|artistic license|artistic license(?: v| version)? 1 0
artistic|2|artistic license|(?:the )?artistic license
artistic|1|same terms as perl|(?:under )?(?:the )?same terms as perl itself
python|2|python software foundation license|python software foundation license(?: version 2)?
python|1|psf license|psf license
php|2|php license|(?:the )?php license(?: version 3 0\d?)?
ruby|2|ruby license|(?:the )?ruby license
openssl|2|openssl license|(?:the )?openssl license
ssleay|2|ssleay license|(?:the )?(?:original )?ssleay license
postgresql|2|postgresql licen|(?:the )?postgresql licen[cs]e
curl|2|curl license|(?:the )?curl license
ncsa|2|university of illinois|university of illinois ncsa open source license
ncsa|2|ncsa open source license|ncsa open source license
upl|2|universal permissive license|universal permissive license(?: v| version)?(?: 1 0)?
ms-pl|2|microsoft public license|microsoft public license
ms-rl|2|microsoft reciprocal license|microsoft reciprocal license
apsl|2|apple public source license|apple public source license(?: v| version)?(?: 2 0)?
osl|2|open software license|open software license(?: v| version)?(?: 3 0)?
afl|2|academic free license|academic free license(?: v| version)?(?: 3 0)?
ecl|2|educational community license|educational community license(?: v| version)?(?: 2 0)?
lppl|2|latex project public license|latex project public license
ofl|3|open font license|sil open font license(?: v| version)? 1 1
ofl|2|open font license|(?:sil )?open font license
ofl|1|scripts sil org ofl|(?:http|https)? ?scripts sil org ofl
bitstream-vera|2|bitstream vera|bitstream vera (?:fonts )?(?:license|copyright)
odbl|2|open database license|(?:odc )?open database license(?: v| version)?(?: 1 0)?
odc-by|2|open data commons attribution|open data commons attribution license
pddl|2|public domain dedication and license|public domain dedication and license
cdla-permissive|2|community data license agreement permissive|community data license agreement permissive
cdla-sharing|2|community data license agreement sharing|community data license agreement sharing
ogl-uk|2|open government licen|open government licen[cs]e(?: v| version)?(?: \d 0)?
etalab|2|licence ouverte|licence ouverte(?: open licence)?(?: v| version)?(?: \d 0)?
dl-de|2|datenlizenz deutschland|datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?
free-art|2|free art license|free art license
free-art|2|licence art libre|licence art libre
opl|2|open publication license|open publication license
ogl|2|open gaming license|open gaming license
sspl|2|server side public license|server side public license(?: v| version)?(?: 1)?
bsl-1.1|2|business source license|business source license(?: v| version)?(?: 1 1)?
elastic|2|elastic license|elastic license(?: v| version)?(?: 2 0)?
commons-clause|2|commons clause|commons clause(?: license condition)?
polyform|2|polyform|polyform (?:noncommercial|strict|shield|small business|internal use|perimeter) license
confluent|2|confluent community license|confluent community license
rail|2|responsible ai license|(?:open ?)?rail responsible ai license
openrail-m|2|creativeml open|creativeml open ?rail ?m(?: license)?
openrail-m|2|bigscience open|bigscience open ?rail ?m(?: license)?
openrail-m|2|bigcode open|bigcode open ?rail ?m(?: license)?
llama|2|llama|llama (?:2 |3 )?community license(?: agreement)?
gemma|2|gemma terms of use|gemma terms of use
cc0|3|cc0|cc0 1 0 universal
cc0|2|cc0|cc0
cc0|2|creative commons zero|creative commons zero
cc-pdm|2|public domain mark|public domain mark(?: 1 0)?
cc|1|creative commons|creative commons
cc|1|creativecommons org|creativecommons org licenses
cc-by|2|cc by|cc by
cc-by|2|creative commons attribution|creative commons attribution(?: license)?
cc-by-sa|2|creative commons attribution|creative commons attribution share ?alike(?: license)?
cc-by-nd|2|creative commons attribution|creative commons attribution no ?deriv(?:ative)?s?(?: license)?
cc-by-nc|2|creative commons attribution|creative commons attribution non ?commercial(?: license)?
cc-by-nc-sa|2|creative commons attribution|creative commons attribution non ?commercial share ?alike(?: license)?
cc-by-nc-nd|2|creative commons attribution|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: license)?
public-domain|2|dedicated to the public domain|(?:is )?dedicated to the public domain
public-domain|2|released into the public domain|(?:is )?released into the public domain
public-domain|1|in the public domain|(?:is )?in the public domain
all-rights-reserved|2|all rights reserved|all rights reserved
all-rights-reserved|2|alle rechte vorbehalten|alle rechte vorbehalten
all-rights-reserved|2|tous droits réservés|tous droits réservés
all-rights-reserved|2|todos los derechos reservados|todos los derechos reservados
proprietary|2|proprietary and confidential|(?:unpublished )?proprietary and confidential
proprietary|1|proprietary license|proprietary license
proprietary|1|unauthorized copying|unauthorized copying of this (?:file|document|work)
commercial|1|commercial license|commercial license
eula|2|end user license agreement|end user license agreement
warranty-disclaimer|1|without warranty of any kind|without warranty of any kind(?: express or implied)?
warranty-disclaimer|1|without warranties or conditions|without warranties or conditions of any kind
copyright|0|copyright|copyright(?: c)? \d{4}
copyright|0|copyright|copyright by
spdx|0|spdx license identifier|spdx license identifier
license|0|licensed under|licensed under the terms
license|0|see license|see license (?:file )?for details
license|0|see the license|see the license (?:file )?for details
license|0|see the file license|see the file license
"""


def _families() -> list[tuple[str, int, str, str]]:
    """Names that differ by version or clause only, from rules."""
    out = []
    for name, words in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero ")):
        for v in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}[name]:
            label = f"{name}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            zero = "" if " " in v else "(?: 0)?"
            out.append((label, 3, f"{words}general public license", rf"(?:gnu )?{words}general public license{VER} ?{v}{zero}"))
            out.append((label, 3, f"{name} {v}", rf"{name} {v}{zero}(?: only| or later)?"))
            out.append((label, 3, f"{name}v{v}", rf"{name}v{v}{zero}"))
    for code, name in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?")):
        if code != "by":
            out.append((f"cc-{code.replace(' ', '-')}", 2, f"cc {code}", f"cc {code}"))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{code.replace(' ', '-')}-{v.replace(' ', '.')}"
            out.append((label, 3, f"cc {code} {v}", f"cc {code} {v}(?: international| unported| generic)?"))
            out.append((label, 3, "creative commons attribution", rf"creative commons {name}(?: license)? {v}(?: international| unported| generic)?"))
            out.append((label, 3, "creativecommons org licenses", rf"creativecommons org licenses {code} {v}"))
    return out


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: label, rank, keyword, regex."""
    written = [line.split("|", 3) for line in WRITTEN.strip().split("\n")]
    return [(label, int(rank), key, regex) for label, rank, key, regex in written] + _families()
