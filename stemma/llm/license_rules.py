"""The signature rules of the license scan: ordered, each gated by a keyword that its regex must contain.

The keyword of a row is taken for those of its alternatives that contain it, else a literal of the alternative.

Texts are matched as lower-case words joined by one blank (so "Apache-2.0" is "apache 2 0"). A row of TABLE is

    label | keyword | tag forms | names with version or title | bare names or notices | addresses

with alternatives parted by ";". Tag forms follow "spdx license identifier" or "license" as a tag. Each alternative
is a rule of its own; its kind gives its priority and score, the order of rows breaks ties.
"""

from __future__ import annotations

from re import _constants, _parser
from typing import NamedTuple

#: kind -> (priority, score)
KINDS = {"tag": (5, 1.0), "text": (4, 0.95), "url": (3, 0.9), "title": (2, 0.9), "name": (1, 0.7), "notice": (0, 0.4)}

TABLE = r"""
mit | licen | mit | the mit license;mit license mit;mit expat license;expat license;licensed under (?:the )?mit(?: license)?;released under (?:the )?mit(?: license)? | mit license;mit licence;mit licensed | opensource org licenses? mit;mit license org;choosealicense com licenses mit
mit-0 | licen | mit 0 | mit no attribution(?: license)? | mit zero license | opensource org licenses? mit 0
apache-2.0 | apache | apache 2 0;apache 2;apache license 2 0 | apache license version 2(?: 0)?;apache license v ?2(?: 0)?;apache software license version 2(?: 0)?;apache 2(?: 0)? licen[cs]e;apache public license 2(?: 0)?;asl 2 0 | apache 2 0;apachev2 | apache org licenses license 2 0;opensource org licenses? apache 2 0
apache-1.1 | apache | apache 1 1 | apache license version 1 1;apache software license version 1 1;apache 1 1 license | apache 1 1 | apache org licenses license 1 1
apache-1.0 | apache | apache 1 0 | apache license version 1 0;apache software license version 1 0;apache 1 0 license | apache 1 0 | apache org licenses license 1 0
apache | apache | apache | apache software license;the apache license | apache licen[cs]e;apache licensed | apache org licenses
gpl-3.0 | gpl | gpl 3 0(?: only| or later)?;gpl 3;gplv3;gpl v3 | gpl version 3;gpl v ?3(?: 0)?;gpl 3 0 | gplv3;gpl 3 | opensource org licenses? gpl 3 0
gpl-3.0 | general public | gnu general public license 3 | gnu general public license(?: as published by the free software foundation)? (?:version|v) 3;general public license version 3;general public license v3;version 3 of the gnu general public license;gnu gpl version 3 | gnu general public license 3 | gnu org licenses gpl 3 0
gpl-2.0 | gpl | gpl 2 0(?: only| or later)?;gpl 2;gplv2;gpl v2 | gpl version 2;gpl v ?2(?: 0)?;gpl 2 0 | gplv2;gpl 2 | opensource org licenses? gpl 2 0
gpl-2.0 | general public | gnu general public license 2 | gnu general public license(?: as published by the free software foundation)? (?:version|v) 2;general public license version 2;general public license v2;version 2 of the gnu general public license;gnu gpl version 2 | gnu general public license 2 | gnu org licenses old licenses gpl 2 0
gpl-1.0 | general public | gnu general public license 1 | gnu general public license version 1;general public license version 1 | gnu general public license 1 | gnu org licenses old licenses gpl 1 0
gpl | general public | gnu general public license | the gnu general public license;free software you can redistribute it and or modify it under the terms of the gnu general public license | general public license;gnu public license | gnu org licenses gpl;gnu org copyleft gpl
gpl | gpl | gpl | the gnu gpl;licensed under (?:the )?gpl;released under (?:the )?gpl;under the terms of the gpl | gnu gpl;gpl licensed;gpl license | opensource org licenses? gpl license
lgpl-3.0 | lesser general | gnu lesser general public license 3 | gnu lesser general public license(?: as published by the free software foundation)? (?:version|v) 3;lesser general public license version 3;version 3 of the gnu lesser general public license | lesser general public license 3 | gnu org licenses lgpl 3 0
lgpl-3.0 | lgpl | lgpl 3 0(?: only| or later)?;lgpl 3;lgplv3 | lgpl version 3;lgpl v ?3 | lgplv3 | opensource org licenses? lgpl 3 0
lgpl-2.1 | lesser general | gnu lesser general public license 2 1 | gnu lesser general public license(?: as published by the free software foundation)? (?:version|v) 2 1;lesser general public license version 2 1;version 2 1 of the gnu lesser general public license | lesser general public license 2 1 | gnu org licenses old licenses lgpl 2 1
lgpl-2.1 | lgpl | lgpl 2 1(?: only| or later)?;lgplv2 1 | lgpl version 2 1;lgpl v ?2 1 | lgplv2 1 | opensource org licenses? lgpl 2 1
lgpl-2.0 | library general | gnu library general public license 2 | gnu library general public license version 2;library general public license version 2 | library general public license | gnu org licenses old licenses lgpl 2 0
lgpl | lgpl | lgpl | the gnu lgpl;licensed under (?:the )?lgpl | gnu lgpl;lgpl license | gnu org licenses lgpl
lgpl | lesser general | gnu lesser general public license | the gnu lesser general public license | lesser general public license | gnu org copyleft lesser
agpl-3.0 | agpl | agpl 3 0(?: only| or later)?;agpl 3;agplv3 | agpl version 3;agpl v ?3 | agplv3;gnu agpl | opensource org licenses? agpl 3 0
agpl-3.0 | affero | gnu affero general public license 3 | gnu affero general public license(?: as published by the free software foundation)? (?:version|v) 3;affero general public license version 3 | affero general public license | gnu org licenses agpl 3 0
agpl-1.0 | affero | affero general public license 1 | affero general public license version 1 | affero inc general public license | affero org oagpl
gfdl-1.3 | free documentation | gnu free documentation license 1 3 | gnu free documentation license version 1 3;free documentation license version 1 3 | free documentation license 1 3 | gnu org licenses fdl 1 3
gfdl-1.2 | free documentation | gnu free documentation license 1 2 | gnu free documentation license version 1 2;free documentation license version 1 2 | free documentation license 1 2 | gnu org licenses old licenses fdl 1 2
gfdl | free documentation | gnu free documentation license | the gnu free documentation license | free documentation license | gnu org licenses fdl
gfdl | gfdl | gfdl(?: 1 \d)? | gfdl version 1 \d | gfdl | gnu org copyleft fdl
bsd-2-clause | bsd | bsd 2 clause | bsd 2 clause licen[cs]e;2 clause bsd licen[cs]e;simplified bsd licen[cs]e;freebsd licen[cs]e;two clause bsd licen[cs]e | bsd 2 clause;2 clause bsd | opensource org licenses? bsd 2 clause
bsd-3-clause | bsd | bsd 3 clause | bsd 3 clause licen[cs]e;3 clause bsd licen[cs]e;new bsd licen[cs]e;modified bsd licen[cs]e;revised bsd licen[cs]e;three clause bsd licen[cs]e | bsd 3 clause;3 clause bsd | opensource org licenses? bsd 3 clause
bsd-4-clause | bsd | bsd 4 clause | bsd 4 clause licen[cs]e;4 clause bsd licen[cs]e;original bsd licen[cs]e;old bsd licen[cs]e | bsd 4 clause;4 clause bsd | spdx org licenses bsd 4 clause
0bsd | bsd | 0bsd | zero clause bsd(?: licen[cs]e)?;bsd zero clause licen[cs]e | 0bsd | opensource org licenses? 0bsd
bsd | bsd | bsd | the bsd licen[cs]e;licensed under (?:the )?bsd(?: licen[cs]e)?;bsd style licen[cs]e | bsd licen[cs]e;bsd licensed | opensource org licenses? bsd license
mpl-2.0 | mpl | mpl 2 0;mpl 2 | mpl version 2(?: 0)?;mpl v ?2(?: 0)? | mpl 2 0;mplv2 | opensource org licenses? mpl 2 0
mpl-2.0 | mozilla | mozilla public license 2 0 | mozilla public license v?(?: ?version)? ?2(?: 0)?;mozilla public license v 2 0 | mozilla public license 2 0 | mozilla org mpl 2 0;mozilla org en us mpl 2 0
mpl-1.1 | mozilla | mozilla public license 1 1 | mozilla public license version 1 1;mozilla public license v 1 1 | mozilla public license 1 1 | mozilla org mpl mpl 1 1
mpl | mozilla | mozilla public license | the mozilla public license | mozilla public licen[cs]e | mozilla org mpl
epl-2.0 | eclipse | eclipse public license 2 0 | eclipse public license (?:version |v )?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0;eclipse org legal epl v20
epl-1.0 | eclipse | eclipse public license 1 0 | eclipse public license (?:version |v )?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl | eclipse | eclipse public license | the eclipse public license | eclipse public licen[cs]e | eclipse org legal
edl-1.0 | eclipse | eclipse distribution license 1 0 | eclipse distribution license (?:version |v )?1(?: 0)? | eclipse distribution license | eclipse org org documents edl v10
cddl-1.0 | common development | common development and distribution license 1 0 | common development and distribution license (?:version )?1(?: 0)? | common development and distribution license | opensource org licenses? cddl 1 0
cddl-1.1 | cddl | cddl 1 1 | cddl version 1 1;cddl 1 1 | cddl | glassfish java net public cddl
cpl-1.0 | common public | common public license 1 0 | common public license (?:version |v )?1(?: 0)? | common public license | opensource org licenses? cpl1 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0 | cc by nc nd 4 0 | cc by nc nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0 | cc by nc sa 4 0 | cc by nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | cc by | cc by nc 4 0 | cc by nc 4 0 | cc by nc | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | cc by | cc by nd 4 0 | cc by nd 4 0 | cc by nd | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | cc by | cc by sa 4 0 | cc by sa 4 0 | cc by sa | creativecommons org licenses by sa 4 0
cc-by-4.0 | cc by | cc by 4 0 | cc by 4 0 | cc by | creativecommons org licenses by 4 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0 | cc by nc nd 3 0 | cc by nc nd 3 | creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0 | cc by nc sa 3 0 | cc by nc sa 3 | creativecommons org licenses by nc sa 3 0
cc-by-nc-3.0 | cc by | cc by nc 3 0 | cc by nc 3 0 | cc by nc 3 | creativecommons org licenses by nc 3 0
cc-by-nd-3.0 | cc by | cc by nd 3 0 | cc by nd 3 0 | cc by nd 3 | creativecommons org licenses by nd 3 0
cc-by-sa-3.0 | cc by | cc by sa 3 0 | cc by sa 3 0 | cc by sa 3 | creativecommons org licenses by sa 3 0
cc-by-3.0 | cc by | cc by 3 0 | cc by 3 0 | cc by 3 | creativecommons org licenses by 3 0
cc-by-sa-2.5 | cc by | cc by sa 2 5 | cc by sa 2 5 | cc by sa 2 | creativecommons org licenses by sa 2 5
cc-by-2.0 | cc by | cc by 2 0 | cc by 2 0 | cc by 2 | creativecommons org licenses by 2 0
cc-by-nc-nd | creative commons | creative commons by nc nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \d 0)?(?: international| unported)?(?: license)? | creative commons by nc nd | creativecommons org licenses by nc nd
cc-by-nc-sa | creative commons | creative commons by nc sa | creative commons attribution non ?commercial share ?alike(?: \d 0)?(?: international| unported)?(?: license)? | creative commons by nc sa | creativecommons org licenses by nc sa
cc-by-nc | creative commons | creative commons by nc | creative commons attribution non ?commercial(?: \d 0)?(?: international| unported)?(?: license)? | creative commons by nc | creativecommons org licenses by nc
cc-by-nd | creative commons | creative commons by nd | creative commons attribution no ?deriv(?:ative)?s?(?: \d 0)?(?: international| unported)?(?: license)? | creative commons by nd | creativecommons org licenses by nd
cc-by-sa | creative commons | creative commons by sa | creative commons attribution share ?alike(?: \d 0)?(?: international| unported)?(?: license)? | creative commons by sa | creativecommons org licenses by sa
cc-by | creative commons | creative commons by | creative commons attribution(?: \d 0)?(?: international| unported| generic)?(?: license)? | creative commons by | creativecommons org licenses by
cc | creative commons | creative commons | a creative commons licen[cs]e | creative commons licen[cs]e;creative commons | creativecommons org
cc0-1.0 | cc0 | cc0 1 0;cc0 | cc0 1 0(?: universal)?;cc0 public domain dedication;cc 0 1 0 universal | cc0 | creativecommons org publicdomain zero 1 0
pdm | public domain | public domain mark | public domain mark 1 0;dedicated to the public domain;released into the public domain;placed in the public domain;in the public domain | public domain | creativecommons org publicdomain mark
unlicense | licen | unlicense | the unlicense;this is free and unencumbered software released into the public domain | unlicense | unlicense org
wtfpl | public licen | wtfpl | do what the fuck you want to public license;do what the f you want to public license;wtf public license version 2 | wtf public license | wtfpl net
isc | isc | isc | the isc licen[cs]e;licensed under (?:the )?isc | isc licen[cs]e;isc licensed | opensource org licenses? isc
zlib | zlib | zlib | the zlib licen[cs]e;zlib libpng licen[cs]e | zlib licen[cs]e | opensource org licenses? zlib
libpng | libpng | libpng 2 0;libpng | png reference library license version 2;libpng licen[cs]e version 2 | libpng licen[cs]e | libpng org pub png src libpng license
bsl-1.0 | boost | bsl 1 0 | boost software license (?:version )?1(?: 0)? | boost software licen[cs]e;boost licen[cs]e | boost org license 1 0
bsl-1.1 | business source | business source license 1 1 | business source license (?:version )?1 1 | business source licen[cs]e | mariadb com bsl11
ms-pl | microsoft | ms pl | microsoft public licen[cs]e | ms pl | opensource org licenses? ms pl
ms-rl | microsoft | ms rl | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses? ms rl
artistic-2.0 | artistic | artistic 2 0 | artistic licen[cs]e (?:version )?2(?: 0)?;artistic 2 0 | artistic license 2 | opensource org licenses? artistic license 2 0
artistic-1.0 | artistic | artistic 1 0(?: perl| cl8)? | artistic licen[cs]e (?:version )?1(?: 0)?;the clarified artistic licen[cs]e | artistic license 1 | opensource org licenses? artistic license 1 0
artistic | artistic | artistic | the artistic licen[cs]e;same terms as perl itself | artistic licen[cs]e | perlfoundation org artistic license
psf-2.0 | python | psf 2 0;python 2 0 | python software foundation licen[cs]e(?: version 2)?;psf licen[cs]e(?: agreement)?(?: version 2)?;python license 2 0 | python software foundation license agreement | python org psf license;docs python org 3 license
ofl-1.1 | open font | ofl 1 1 | sil open font licen[cs]e (?:version )?1 1;open font licen[cs]e version 1 1 | open font licen[cs]e | scripts sil org ofl
ofl-1.0 | open font | ofl 1 0 | sil open font licen[cs]e (?:version )?1 0 | open font licen[cs]e 1 0 | scripts sil org ofl10
eupl-1.2 | eupl | eupl 1 2 | eupl (?:version |v )?1 2;european union public licen[cs]e (?:version |v )?1 2 | eupl | joinup ec europa eu (?:\w+ )*eupl
eupl-1.1 | european union public | european union public license 1 1 | european union public licen[cs]e (?:version |v )?1 1 | european union public licen[cs]e | opensource org licenses? eupl 1 1
osl-3.0 | open software | osl 3 0 | open software licen[cs]e (?:version |v )?3(?: 0)? | open software licen[cs]e | opensource org licenses? osl 3 0
afl-3.0 | academic free | afl 3 0 | academic free licen[cs]e (?:version |v )?3(?: 0)? | academic free licen[cs]e | opensource org licenses? afl 3 0
ecl-2.0 | educational community | ecl 2 0 | educational community licen[cs]e (?:version )?2(?: 0)? | educational community licen[cs]e | opensource org licenses? ecl 2 0
ncsa | ncsa | ncsa | university of illinois ncsa open source licen[cs]e;illinois ncsa licen[cs]e | ncsa open source licen[cs]e;ncsa licen[cs]e | opensource org licenses? ncsa
odbl-1.0 | open database | odbl 1 0 | open database licen[cs]e (?:version |v )?1(?: 0)?;open data commons open database licen[cs]e | open database licen[cs]e | opendatacommons org licenses odbl
odc-by-1.0 | open data commons | odc by 1 0 | open data commons attribution licen[cs]e(?: 1 0| v1 0)? | open data commons attribution | opendatacommons org licenses by
pddl-1.0 | open data commons | pddl 1 0 | open data commons public domain dedication(?: and license)?(?: 1 0)? | public domain dedication and licen[cs]e | opendatacommons org licenses pddl
cdla-permissive-2.0 | community data | cdla permissive 2 0 | community data licen[cs]e agreement permissive (?:version )?2(?: 0)? | community data licen[cs]e agreement permissive | cdla (?:dev|io) permissive 2 0
cdla-sharing-1.0 | community data | cdla sharing 1 0 | community data licen[cs]e agreement sharing (?:version )?1(?: 0)? | community data licen[cs]e agreement sharing | cdla (?:dev|io) sharing 1 0
ogl-3.0 | open government | ogl uk 3 0 | open government licen[cs]e (?:version |v )?3(?: 0)? | open government licen[cs]e | nationalarchives gov uk doc open government licence version 3
sspl-1.0 | server side | sspl 1 0 | server side public licen[cs]e (?:version |v )?1 | server side public licen[cs]e | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic 2 0 | elastic licen[cs]e (?:version |v )?2(?: 0)? | elastic licen[cs]e | elastic co licensing elastic license
openrail | openrail | openrail(?: m)? | creativeml open ?rail m;bigscience openrail m licen[cs]e;bigscience bloom rail 1 0 | openrail m;openrail licen[cs]e | bigscience huggingface co blog the bigscience rail license
llama-community | community licen | llama2;llama3;llama3 1 | llama \d(?: \d)? community licen[cs]e(?: agreement)? | llama community licen[cs]e | ai meta com llama license
vim | vim | vim | the vim licen[cs]e | vim licen[cs]e | vimhelp org uganda
ruby | ruby | ruby | the ruby licen[cs]e;same terms as ruby | ruby licen[cs]e | ruby lang org en about license
php-3.01 | php | php 3 01 | php licen[cs]e (?:version |v )?3 01 | php licen[cs]e | php net license 3 01
openssl | openssl | openssl | openssl licen[cs]e original ssleay licen[cs]e;the openssl licen[cs]e | openssl licen[cs]e | openssl org source license
ijg | jpeg group | ijg | based in part on the work of the independent jpeg group | independent jpeg group licen[cs]e | ijg org files readme
proprietary | rights reserved | proprietary | all rights reserved;no part of this (?:publication|work|book) may be reproduced | rights reserved | copyright gov title17
commercial-restricted | non commercial | non commercial | for non commercial use only;non commercial use only;non commercial research purposes only | non commercial license | eula non commercial
"""

#: Sentences of licence texts and notices: label | keyword | text rule.
TEXTS = r"""
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-3-clause | redistribution and use | neither the name of (?:the )?(?:\w+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered | anyone is free to copy modify publish use compile sell or distribute this software
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
cc0-1.0 | cc0 | to the extent possible under law (?:\w+ ){1,12}waived all copyright and related
ofl-1.1 | reserved font | no modified version of the font software may use the reserved font name
wtfpl | what the | you just do what the fuck you want to
proprietary | confidential | confidential and proprietary information
notice | licen | licensed under (?:the )?terms
notice | licen | see (?:the )?licen[cs]e file
notice | copyright | copyright (?:c )?(?:19|20)\d\d
"""

#: Words that open the gate for rules whose regex must contain them; any other rule opens it by a literal of its own.
COMMON = ["licen", "copyright", "spdx", "gpl", "general public", "creative commons", "creativecommons", "cc by", "cc0", "public domain", "rights reserved", "bsd", "apache", "mozilla", "non commercial", "redistribut", "permission"]

#: The phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Rule(NamedTuple):
    order: int
    keyword: str
    priority: int
    score: float
    label: str
    pattern: str


def literals(words: str) -> list[str]:
    """Literal strings that every match of a regex contains."""
    out = [""]
    for op, value in _parser.parse(words):
        if op is _constants.LITERAL:
            out[-1] += chr(value)
        else:
            out.append("")
    return [x for x in out if x.strip()]


def _keyword(words: str, wanted: list[str]) -> str:
    """The first of wanted that a regex must contain, or its longest literal."""
    held = literals(words)
    return next((k for k in wanted if any(k in x for x in held)), max(held, key=len))


def _rows(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, keyword: str, kind: str, words: str) -> None:
        priority, score = KINDS[kind]
        out.append(Rule(len(out), _keyword(words, [keyword, "spdx"]), priority, score, label, rf"(?<![^ ])(?:{words})(?![^ ])"))

    for label, keyword, text in _rows(TEXTS):
        add(label, keyword, "notice" if label == "notice" else "text", text)
    for label, keyword, tags, titles, names, urls in _rows(TABLE):
        for kind, cell in (("tag", tags), ("title", titles), ("name", names), ("url", urls)):
            for words in cell.split(";"):
                add(label, keyword, kind, rf"spdx license identifier {words}" if kind == "tag" else words)
    return out


def _gate() -> list[str]:
    inner = lambda pattern: pattern.removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])")
    return list(dict.fromkeys([*COMMON, *(_keyword(inner(r.pattern), COMMON) for r in rules())]))


#: Keywords of which a text must hold one to be looked at by any rule; every rule's regex contains one.
GATE = _gate()
