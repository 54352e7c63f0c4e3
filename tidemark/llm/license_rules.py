"""Signature rules for licenses, in order: within a kind an earlier rule wins over a later one with the same words.

One rule a line: `label: before [keyword] after`. Rules are regular expressions over a text's words, lower-cased and parted by
single blanks; `before` must end at the keyword and `after` must start behind it. The keyword is a plain word, and the rule
is tried only where that word stands. Expressions keep to what Java and RE2 read alike, name words by `\\w` only, and
reach at most BEFORE words back and AFTER words ahead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BEFORE, AFTER = 24, 32

#: Phrases whose every place is reported and whose labels always stay.
BASE = """
mit: under the [mit] license
apache-2: [apache] license version 2
cc-by-nc: [cc] by nc
"""

#: Machine-readable tags: `SPDX-License-Identifier: <name>`, package metadata and classifier lines.
TAG = """
mit: [spdx] license identifier (mit|x11)
mit-0: [spdx] license identifier mit 0
apache-2: [spdx] license identifier apache 2 0
apache-1.1: [spdx] license identifier apache 1 1
apache-1.0: [spdx] license identifier apache 1 0
bsd-2: [spdx] license identifier bsd 2 clause
bsd-3: [spdx] license identifier bsd 3 clause
bsd-4: [spdx] license identifier bsd 4 clause
0bsd: [spdx] license identifier 0bsd
isc: [spdx] license identifier isc
zlib: [spdx] license identifier zlib
gpl-1: [spdx] license identifier gpl 1 0( only| or later)?
gpl-2-or-later: [spdx] license identifier gpl 2 0 or later
gpl-2: [spdx] license identifier gpl 2 0( only)?
gpl-3-or-later: [spdx] license identifier gpl 3 0 or later
gpl-3: [spdx] license identifier gpl 3 0( only)?
lgpl-2: [spdx] license identifier lgpl 2 0( only| or later)?
lgpl-2.1: [spdx] license identifier lgpl 2 1( only| or later)?
lgpl-3: [spdx] license identifier lgpl 3 0( only| or later)?
agpl-1: [spdx] license identifier agpl 1 0( only| or later)?
agpl-3: [spdx] license identifier agpl 3 0( only| or later)?
mpl-1.0: [spdx] license identifier mpl 1 0
mpl-1.1: [spdx] license identifier mpl 1 1
mpl-2.0: [spdx] license identifier mpl 2 0
epl-1.0: [spdx] license identifier epl 1 0
epl-2.0: [spdx] license identifier epl 2 0
eupl-1.1: [spdx] license identifier eupl 1 1
eupl-1.2: [spdx] license identifier eupl 1 2
cddl-1.0: [spdx] license identifier cddl 1 0
cddl-1.1: [spdx] license identifier cddl 1 1
artistic-1: [spdx] license identifier artistic 1 0( perl)?
artistic-2: [spdx] license identifier artistic 2 0
boost-1.0: [spdx] license identifier bsl 1 0
bsl-1.1: [spdx] license identifier busl 1 1
cc0-1.0: [spdx] license identifier cc0 1 0
cc-by-3.0: [spdx] license identifier cc by 3 0
cc-by-4.0: [spdx] license identifier cc by 4 0
cc-by-sa-3.0: [spdx] license identifier cc by sa 3 0
cc-by-sa-4.0: [spdx] license identifier cc by sa 4 0
cc-by-nc-4.0: [spdx] license identifier cc by nc 4 0
cc-by-nd-4.0: [spdx] license identifier cc by nd 4 0
cc-by-nc-sa-4.0: [spdx] license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0: [spdx] license identifier cc by nc nd 4 0
unlicense: [spdx] license identifier unlicense
wtfpl: [spdx] license identifier wtfpl
python-2.0: [spdx] license identifier (python 2 0|psf 2 0)
ofl-1.1: [spdx] license identifier ofl 1 1
odbl-1.0: [spdx] license identifier odbl 1 0
sspl-1.0: [spdx] license identifier sspl 1 0
elastic-2.0: [spdx] license identifier elastic 2 0
polyform-nc: [spdx] license identifier polyform noncommercial 1 0 0
ms-pl: [spdx] license identifier ms pl
ms-rl: [spdx] license identifier ms rl
upl-1.0: [spdx] license identifier upl 1 0
mulan-2: [spdx] license identifier mulanpsl 2 0
ecl-2.0: [spdx] license identifier ecl 2 0
postgresql: [spdx] license identifier postgresql
openssl: [spdx] license identifier openssl
unicode: [spdx] license identifier unicode( dfs 2016| 3 0)?
blueoak-1.0: [spdx] license identifier blueoak 1 0 0
mit: license osi approved [mit] license
apache-2: license osi approved [apache] software license
bsd: license osi approved [bsd] license
isc: license osi approved [isc] license( iscl)?
gpl-2: license osi approved gnu general public license v2 [gplv2]
gpl-3: license osi approved gnu general public license v3 [gplv3]
gpl-2-or-later: license osi approved gnu general public license v2 or later [gplv2]
gpl-3-or-later: license osi approved gnu general public license v3 or later [gplv3]
lgpl-2.1: license osi approved gnu lesser general public license v2 [lgplv2]
lgpl-3: license osi approved gnu lesser general public license v3 [lgplv3]
agpl-3: license osi approved gnu affero general public license v3( or later)? [agplv3]
mpl-2.0: license osi approved mozilla public license 2 0 [mpl] 2 0
python-2.0: license osi approved [python] software foundation license
unlicense: license osi approved the [unlicense]( unlicense)?
"""

#: Grants and passages of license texts.
NOTICE = """
mit: (released|licensed|distributed|published|available|provided) under (the )?(terms of )?(the )?[mit] (x11 )?licen[sc]e
mit: (this )?(software|project|code|work|package|library) is (released |licensed |distributed )?under (the )?[mit]( licen[sc]e)?
mit: permission is hereby [granted] free of charge to any person obtaining a copy of this software and associated documentation files
mit: the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial [portions] of the software
mit-0: [granted] free of charge to any person obtaining a copy of this software without restriction
apache-2: (released|licensed|distributed|published|available) under (the )?(terms of )?(the )?[apache] (software )?licen[sc]e( version)? (2|v2|2 0)( 0)?
apache-2: you may not use this file except in compliance with the [license]( you may obtain a copy of the license at http www apache org licenses license 2 0)
apache-2: http www [apache] org licenses license 2 0( txt| html)?
apache-1.1: (licensed|distributed) under (the )?[apache] software license version 1 1
apache-1.0: (licensed|distributed) under (the )?[apache] (group )?license version 1 0
bsd-2: (released|licensed|distributed|available) under (the )?(terms of )?(the )?(2 clause|two clause|simplified|freebsd) [bsd] licen[sc]e
bsd-3: (released|licensed|distributed|available) under (the )?(terms of )?(the )?(3 clause|three clause|new|modified|revised) [bsd] licen[sc]e
bsd-4: (released|licensed|distributed|available) under (the )?(terms of )?(the )?(4 clause|four clause|original|old) [bsd] licen[sc]e
bsd: (released|licensed|distributed|available) under (the |a )?(terms of )?(the )?[bsd]( style| like)? licen[sc]e
bsd: [redistribution] and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3: neither the name of .{1,60} nor the names of its [contributors] may be used to endorse or promote products
bsd-4: all [advertising] materials mentioning features or use of this software must display the following acknowledg(e)?ment
isc: [permission] to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc: (released|licensed|distributed|available) under (the )?(terms of )?(the )?[isc] licen[sc]e
zlib: this software is provided as is without any express or implied [warranty] in no event will the authors be held liable
zlib: the origin of this software must not be [misrepresented]
zlib: (released|licensed|distributed|available) under (the )?(terms of )?(the )?[zlib]( libpng)? licen[sc]e
gpl-1: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[gpl] (version |v )?1( 0)?
gpl-2-or-later: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[gpl] (version |v )?2( 0)? or( at your option)?( any)? later( version)?
gpl-2: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[gpl] (version |v )?2( 0)?
gpl-3-or-later: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[gpl] (version |v )?3( 0)? or( at your option)?( any)? later( version)?
gpl-3: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[gpl] (version |v )?3( 0)?
gpl-2: (licensed|released|distributed|available) under (the )?(terms of )?(the )?[gplv2]
gpl-3: (licensed|released|distributed|available) under (the )?(terms of )?(the )?[gplv3]
gpl-1: under (the )?(terms of )?(the )?[gnu] general public license( as published by the free software foundation)?( either)? version 1
gpl-2-or-later: under (the )?(terms of )?(the )?[gnu] general public license( as published by the free software foundation)?( either)? version 2( 0)?( of the license)? or( at your option)?( any)? later( version)?
gpl-2: under (the )?(terms of )?(the )?[gnu] general public license( as published by the free software foundation)?( either)? version 2( 0)?( of the license)?
gpl-3-or-later: under (the )?(terms of )?(the )?[gnu] general public license( as published by the free software foundation)?( either)? version 3( 0)?( of the license)? or( at your option)?( any)? later( version)?
gpl-3: under (the )?(terms of )?(the )?[gnu] general public license( as published by the free software foundation)?( either)? version 3( 0)?( of the license)?
lgpl-2: under (the )?(terms of )?(the )?[gnu] library general public license( as published by the free software foundation)?( either)? version 2( 0)?( of the license)?( or( at your option)?( any)? later( version)?)?
lgpl-2.1: under (the )?(terms of )?(the )?[gnu] lesser general public license( as published by the free software foundation)?( either)? version 2 1( of the license)?( or( at your option)?( any)? later( version)?)?
lgpl-3: under (the )?(terms of )?(the )?[gnu] lesser general public license( as published by the free software foundation)?( either)? version 3( 0)?( of the license)?( or( at your option)?( any)? later( version)?)?
agpl-3: under (the )?(terms of )?(the )?[gnu] affero general public license( as published by the free software foundation)?( either)? version 3( 0)?( of the license)?( or( at your option)?( any)? later( version)?)?
agpl-1: under (the )?(terms of )?(the )?[affero] general public license version 1
gfdl: under (the )?(terms of )?(the )?[gnu] free documentation license( version 1 [123])?( or( any)? later( version)?)?
gpl: this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of [merchantability] or fitness for a particular purpose see the gnu general public license
lgpl-2.1: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[lgpl] (version |v )?2 1
lgpl-3: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[lgpl] (version |v )?3( 0)?
agpl-3: (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?[agpl] (version |v )?3( 0)?
mpl-1.0: (subject to|under) (the )?(terms of )?(the )?[mozilla] public license( version| v)? 1 0
mpl-1.1: (subject to|under) (the )?(terms of )?(the )?[mozilla] public license( version| v)? 1 1
mpl-2.0: (subject to|under) (the )?(terms of )?(the )?[mozilla] public license( version| v)? 2( 0)?
mpl-2.0: if a copy of the [mpl] was not distributed with this file you can obtain one at
epl-1.0: under (the )?(terms of )?(the )?[eclipse] public license( version| v)? 1( 0)?
epl-2.0: under (the )?(terms of )?(the )?[eclipse] public license( version| v)? 2( 0)?
cpl-1.0: under (the )?(terms of )?(the )?[common] public license( version| v)? 1( 0)?
edl-1.0: under (the )?(terms of )?(the )?[eclipse] distribution license( version| v)? 1( 0)?
eupl-1.1: under (the )?(terms of )?(the )?[eupl]( version| v)? 1 1
eupl-1.2: under (the )?(terms of )?(the )?[eupl]( version| v)? 1 2
eupl: under (the )?(terms of )?(the )?[european] union public licen[cs]e( version| v)?( 1 [0-2])?
cddl-1.0: under (the )?(terms of )?(the )?[common] development and distribution license( version| v)?( 1 0)?
artistic-2: under (the )?(terms of )?(the )?[artistic] license( version)? 2( 0)?
artistic-1: under (the )?(terms of )?(the )?[artistic] license( version 1 0)?
perl: under the same terms as [perl]( itself| 5)?
boost-1.0: under (the )?(terms of )?(the )?[boost] software license( version 1 0)?
bsl-1.1: under (the )?(terms of )?(the )?[business] source license( version)?( 1 1)?
sspl-1.0: under (the )?(terms of )?(the )?[server] side public license( version| v)?( 1)?
elastic-2.0: under (the )?(terms of )?(the )?[elastic] license( version)?( 2 0)?
polyform-nc: under (the )?(terms of )?(the )?[polyform] noncommercial license( 1 0 0)?
polyform-sb: under (the )?(terms of )?(the )?[polyform] small business license( 1 0 0)?
commons-clause: [commons] clause license condition( v1 0)?
unlicense: this is free and [unencumbered] software released into the public domain
unlicense: (released|licensed|distributed) under (the )?[unlicense]
wtfpl: do what the [fuck] you want to( public license)?
python-2.0: under (the )?(terms of )?(the )?[python] software foundation license( version 2)?
psf: [psf] is making python available to licensee on an as is basis
ofl-1.1: under (the )?(terms of )?(the )?[sil] open font license( version 1 1)?
ofl-1.0: under (the )?(terms of )?(the )?[sil] open font license version 1 0
odbl-1.0: under (the )?(terms of )?(the )?[open] (data commons open )?database license( version)?( 1 0)?
odc-by-1.0: under (the )?(terms of )?(the )?[open] data commons attribution license( v1 0| version 1 0)?
pddl-1.0: [open] data commons public domain dedication( and license| and licence)?
ms-pl: under (the )?(terms of )?(the )?[microsoft] public license( ms pl)?
ms-rl: under (the )?(terms of )?(the )?[microsoft] reciprocal license( ms rl)?
upl-1.0: under (the )?(terms of )?(the )?[universal] permissive license( version| v)?( 1 0)?
mulan-2: under (the )?(terms of )?(the )?[mulan] (psl|permissive software license)( v2| version 2)?
ecl-2.0: under (the )?(terms of )?(the )?[educational] community license( version 2 0)?
afl-3.0: under (the )?(terms of )?(the )?[academic] free license( version| v)?( 3 0)?
osl-3.0: under (the )?(terms of )?(the )?[open] software license( version| v)?( 3 0)?
postgresql: under (the )?(terms of )?(the )?[postgresql] licen[cs]e
openssl: this product includes software developed by the [openssl] project
openssl: under (the )?(terms of )?(the )?[openssl]( ssleay)? license
php-3.01: under (the )?(terms of )?(the )?[php] license( version)?( 3 01| 3 0)?
ruby: under (the )?(terms of )?(the )?(same terms as )?[ruby]( s)? license
vim: under (the )?(terms of )?(the )?[vim] license
ncsa: under (the )?(terms of )?(the )?(university of illinois )?[ncsa]( open source)? license
w3c: under (the )?(terms of )?(the )?[w3c] software (notice and )?license
ibm-pl: under (the )?(terms of )?(the )?[ibm] public license( version 1 0)?
apsl-2.0: under (the )?(terms of )?(the )?[apple] public source license( version)?( 2 0)?
npl-1.1: under (the )?(terms of )?(the )?[netscape] public license( version)?( 1 1)?
sun-pl: under (the )?(terms of )?(the )?[sun] public license( version 1 0)?
qpl-1.0: under (the )?(terms of )?(the )?[q] public license( version 1 0)?
intel: under (the )?(terms of )?(the )?[intel] (open source|simplified software) license
openrail: under (the )?(terms of )?(the )?((creativeml|bigscience|bigcode) )?[openrail]( m| s)?( license)?
llama: under (the )?(terms of )?(the )?[llama] ([23]( [0-9])? )?community license( agreement)?
gemma: under (the )?(terms of )?(the )?[gemma] terms of use
cc-by-nc-sa: under (a |the )?(terms of )?(the )?[creative] commons attribution non ?commercial share ?alike( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc-by-nc-nd: under (a |the )?(terms of )?(the )?[creative] commons attribution non ?commercial no ?deriv(s|atives|ativeworks)( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc-by-nc: under (a |the )?(terms of )?(the )?[creative] commons attribution non ?commercial( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc-by-sa: under (a |the )?(terms of )?(the )?[creative] commons attribution share ?alike( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc-by-nd: under (a |the )?(terms of )?(the )?[creative] commons attribution no ?deriv(s|atives|ativeworks)( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc-by: under (a |the )?(terms of )?(the )?[creative] commons attribution( [1-4] [05])?( international| unported| generic)?( license| licence)?
cc0-1.0: under (a |the )?(terms of )?(the )?[creative] commons (zero|cc0)( 1 0)?( universal)?( license| licence| public domain dedication)?
cc-by-nc-sa-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by nc sa 4 0( international)?( license| licence)?
cc-by-nc-nd-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by nc nd 4 0( international)?( license| licence)?
cc-by-nc-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by nc 4 0( international)?( license| licence)?
cc-by-nc-3.0: (licensed|released|available|distributed) under (a |the )?[cc] by nc 3 0( unported)?( license| licence)?
cc-by-sa-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by sa 4 0( international)?( license| licence)?
cc-by-sa-3.0: (licensed|released|available|distributed) under (a |the )?[cc] by sa 3 0( unported)?( license| licence)?
cc-by-nd-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by nd 4 0( international)?( license| licence)?
cc-by-4.0: (licensed|released|available|distributed) under (a |the )?[cc] by 4 0( international)?( license| licence)?
cc-by-3.0: (licensed|released|available|distributed) under (a |the )?[cc] by 3 0( unported)?( license| licence)?
cc0-1.0: (licensed|released|available|dedicated|waived) (under|with|to|through) (a |the )?[cc0]( 1 0)?( universal)?( license| licence)?
ogl-3.0: contains public sector information licensed under the [open] government licen[cs]e( v| version)?( 3 0)?
ogl-3.0: under (the )?(terms of )?(the )?[open] government licen[cs]e( v| version)?( 3 0)?
public-domain: (released|placed|dedicated|put) (in|into|to) the public [domain]
proprietary: all [rights] reserved( unauthorized (copying|use|reproduction|distribution)( of this (file|work|document))?( via any medium)? is( strictly)? prohibited)
proprietary: proprietary and [confidential]
proprietary: [confidential] and proprietary
proprietary: (may not|must not) be (reproduced|copied|redistributed|distributed|published) without( the)?( prior)?( express)?( written) [permission]
no-commercial-use: (not for|no|prohibits|excluding) [commercial] (use|purposes|exploitation)
no-commercial-use: for (personal|private|research|academic|educational)( and (personal|private|research|academic|educational))? [noncommercial] use only
research-only: for (academic |scientific )?[research] (purposes|use) only
no-ai-training: (not|never) be used (for|to) (the )?(train|training)( of)? (ai|machine learning|artificial intelligence|language) [models]
"""

#: Names and addresses of licenses.
NAME = """
mit: (the )?[mit] (x11 |expat )?licen[sc]e
mit: (the )?[expat] licen[sc]e
mit: (the )?[x11] licen[sc]e
mit: opensource org licenses [mit]
apache-2: (the )?[apache] (software |public )?licen[sc]e( version| v)? 2( 0)?
apache-2: [apache] 2( 0)?( licen[sc]e)?
apache-2: [asl] 2 0
apache-1.1: [apache] (software )?license( version| v)? 1 1
apache-1.0: [apache] (software )?license( version| v)? 1 0
bsd-2: (2 clause|two clause|simplified|freebsd) [bsd]( licen[sc]e)?
bsd-2: [bsd] (2 clause|two clause)( licen[sc]e)?
bsd-3: (3 clause|three clause|new|modified|revised) [bsd]( licen[sc]e)?
bsd-3: [bsd] (3 clause|three clause)( licen[sc]e)?
bsd-4: (4 clause|four clause|original) [bsd]( licen[sc]e)?
bsd-4: [bsd] (4 clause|four clause)( licen[sc]e)?
bsd: [bsd]( style| like)? licen[sc]e
isc: (the )?[isc] licen[sc]e
zlib: (the )?[zlib]( libpng)? licen[sc]e
gpl-1: (gnu )?[gpl] (version |v )?1( 0)?
gpl-2-or-later: (gnu )?[gpl] (version |v )?2( 0)? or( any)? later( version)?
gpl-2: (gnu )?[gpl] (version |v )?2( 0)?( only)?
gpl-3-or-later: (gnu )?[gpl] (version |v )?3( 0)? or( any)? later( version)?
gpl-3: (gnu )?[gpl] (version |v )?3( 0)?( only)?
gpl-2: (gnu )?[gplv2]
gpl-3: (gnu )?[gplv3]
gpl-1: (the )?[gnu] general public license( version| v) 1
gpl-2: (the )?[gnu] general public license( version| v)? 2( 0)?
gpl-3: (the )?[gnu] general public license( version| v)? 3( 0)?
gpl: (the )?[gnu] general public license
gpl: (the )?gnu [gpl]
lgpl-2: (the )?[gnu] library general public license( version| v)?( 2)?( 0)?
lgpl-2.1: (the )?[gnu] lesser general public license( version| v)? 2 1
lgpl-3: (the )?[gnu] lesser general public license( version| v)? 3( 0)?
lgpl: (the )?[gnu] lesser general public license
lgpl-2.1: (gnu )?[lgpl] (version |v )?2 1
lgpl-3: (gnu )?[lgpl] (version |v )?3( 0)?
lgpl-2.1: (gnu )?[lgplv2]( 1)?
lgpl-3: (gnu )?[lgplv3]
lgpl: (gnu )?[lgpl]( license)?
agpl-3: (the )?[gnu] affero general public license( version| v)? 3( 0)?
agpl: (the )?(gnu )?[affero] general public license
agpl-3: (gnu )?[agpl] (version |v )?3( 0)?
agpl-3: (gnu )?[agplv3]
agpl: (gnu )?[agpl]( license)?
gfdl: (the )?[gnu] free documentation license( version 1 [123])?
gfdl: (gnu )?[gfdl]( 1 [123])?
mpl-1.0: (the )?[mozilla] public license( version| v)? 1 0
mpl-1.1: (the )?[mozilla] public license( version| v)? 1 1
mpl-2.0: (the )?[mozilla] public license( version| v)? 2( 0)?
mpl: (the )?[mozilla] public license
mpl-1.1: [mpl] (version |v )?1 1
mpl-2.0: [mpl] (version |v )?2( 0)?
epl-1.0: (the )?[eclipse] public license( version| v)? 1( 0)?
epl-2.0: (the )?[eclipse] public license( version| v)? 2( 0)?
epl: (the )?[eclipse] public license
epl-2.0: [epl] (version |v )?2( 0)?
epl-1.0: [epl] (version |v )?1( 0)?
cpl-1.0: (the )?[common] public license
cpal-1.0: (the )?[common] public attribution license( version 1 0)?
edl-1.0: (the )?[eclipse] distribution license
eupl: (the )?[european] union public licen[cs]e
eupl-1.2: [eupl] (version |v )?1 2
eupl-1.1: [eupl] (version |v )?1 1
cddl-1.0: (the )?[common] development and distribution license
cddl-1.0: [cddl] (version |v )?1 0
cddl-1.1: [cddl] (version |v )?1 1
artistic-2: (the )?[artistic] license( version)? 2( 0)?
artistic-1: (the )?(clarified )?[artistic] license
boost-1.0: (the )?[boost] software license( version)?( 1 0)?
bsl-1.1: (the )?[business] source license( version)?( 1 1)?
sspl-1.0: (the )?[server] side public license
sspl-1.0: [sspl]( v1| 1 0)?
elastic-2.0: (the )?[elastic] license( 2 0| v2)?
polyform-nc: (the )?[polyform] noncommercial
polyform: (the )?[polyform] (strict|shield|free trial|internal use|perimeter)
commons-clause: (the )?[commons] clause
unlicense: (the )?[unlicense]
wtfpl: (the )?[wtfpl]
python-2.0: (the )?[python] software foundation license
psf: [psf] license( agreement)?
ofl-1.1: (the )?(sil )?open [font] license( version)?( 1 1)?
ofl-1.1: [ofl] 1 1
odbl-1.0: open [database] licen[cs]e
odbl-1.0: [odbl]( v?1 0)?
odc-by-1.0: [odc] by( 1 0)?
odc-by-1.0: open data [commons] attribution
pddl-1.0: [pddl]( 1 0)?
ms-pl: [microsoft] public license
ms-rl: [microsoft] reciprocal license
upl-1.0: [universal] permissive license
mulan-2: [mulan] (psl|permissive software license)
ecl-2.0: [educational] community license
afl-3.0: [academic] free license
postgresql: [postgresql] licen[cs]e
openssl: [openssl]( ssleay)? license
php-3.01: [php] license
ruby: [ruby] license
vim: [vim] license
ncsa: [ncsa] (open source )?license
w3c: [w3c] software (notice and )?license
ibm-pl: [ibm] public license
apsl-2.0: [apple] public source license
npl-1.1: [netscape] public license
sun-pl: [sun] public license
qpl-1.0: [qt] public license
sleepycat: [sleepycat] license
beerware: [beerware]( license)?
beerware: the [beer] ware license
json: the software shall be used for good not [evil]
fair: the [fair] license
hippocratic: (the )?[hippocratic] license( 2 1| 3 0)?
blueoak-1.0: [blue] oak model license( 1 0 0)?
openrail: [openrail]( m| s)?
openrail: [creativeml] open ?rail( m)?
openrail: [bigscience] open ?rail( m)?( license)?
llama: [llama] ([23]( [0-9])? )?community license
bigcode: [bigcode] openrail m
cc-by-nc-sa-4.0: [cc] by nc sa 4 0
cc-by-nc-nd-4.0: [cc] by nc nd 4 0
cc-by-nc-4.0: [cc] by nc 4 0
cc-by-nc-3.0: [cc] by nc 3 0
cc-by-nc-sa: [cc] by nc sa
cc-by-nc-nd: [cc] by nc nd
cc-by-sa-4.0: [cc] by sa 4 0
cc-by-sa-3.0: [cc] by sa 3 0
cc-by-sa: [cc] by sa
cc-by-nd-4.0: [cc] by nd 4 0
cc-by-nd: [cc] by nd
cc-by-4.0: [cc] by 4 0
cc-by-3.0: [cc] by 3 0
cc-by: [cc] by
cc0-1.0: [cc0]( 1 0)?( universal)?
cc-by-nc-sa: [creative] commons attribution non ?commercial share ?alike( [1-4] [05])?
cc-by-nc-nd: [creative] commons attribution non ?commercial no ?deriv(s|atives|ativeworks)( [1-4] [05])?
cc-by-nc: [creative] commons attribution non ?commercial( [1-4] [05])?
cc-by-sa: [creative] commons attribution share ?alike( [1-4] [05])?
cc-by-nd: [creative] commons attribution no ?deriv(s|atives|ativeworks)( [1-4] [05])?
cc-by: [creative] commons attribution( [1-4] [05])?
cc0-1.0: [creative] commons zero( 1 0)?
cc-by-nc-sa: [creativecommons] org licenses by nc sa( [1-4] [05])?
cc-by-nc-nd: [creativecommons] org licenses by nc nd( [1-4] [05])?
cc-by-nc: [creativecommons] org licenses by nc( [1-4] [05])?
cc-by-sa: [creativecommons] org licenses by sa( [1-4] [05])?
cc-by-nd: [creativecommons] org licenses by nd( [1-4] [05])?
cc-by: [creativecommons] org licenses by( [1-4] [05])?
cc0-1.0: [creativecommons] org publicdomain zero( 1 0)?
public-domain: [creativecommons] org publicdomain mark( 1 0)?
gpl: www [gnu] org licenses gpl( [23] 0)?( html| txt)?
lgpl: www [gnu] org licenses lgpl( [23] [01])?( html| txt)?
agpl: www [gnu] org licenses agpl( 3 0)?( html| txt)?
mpl-2.0: [mozilla] org mpl 2 0
unlicense: [unlicense] org
boost-1.0: www [boost] org license 1 0 txt
"""

#: Words that speak of licensing without naming a license.
MENTION = """
unknown: (released|licensed|distributed|published|available) under (the |a |an )?(terms of )?(the )?([a-z0-9]+ ){1,4}[license]
unknown: (released|licensed|distributed|published|available) under (the |a |an )?(terms of )?(the )?([a-z0-9]+ ){1,4}[licence]
unknown: see( the)?( file)? [license]( txt| md)?( file)?( for( more)? (details|information))?
unknown: (subject to|governed by) (the )?(following )?(terms of )?(the |this |a )?[license]( agreement)?
creative-commons: [creative] commons( license| licence)?
public-domain: (in |into |of )?the public [domain]
copyleft: [copyleft]
proprietary: [proprietary] (license|licence|software|information)
proprietary: all [rights] reserved
proprietary: end user license agreement [eula]
proprietary: [eula]
open-source: [osi] approved( open source)?( license)?
copyright: (copyright|c) (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])?( by)?( [a-z0-9]+){0,3} all [rights] reserved
"""


@dataclass(frozen=True)
class Rule:
    """kind: 0 base, 1 tag, 2 notice, 3 name, 4 mention; lower kinds win over higher ones."""

    number: int
    kind: int
    label: str
    keyword: str
    before: str
    after: str


#: How far a detection of each kind is to be believed.
CONFIDENCE = (1.0, 1.0, 0.95, 0.8, 0.4)
_LINE = re.compile(r"([a-z0-9.-]+): (.*?)\[([a-z0-9]+)\]((?:[ (].*)?)")


def _parsed() -> list[Rule]:
    lines = [(kind, line) for kind, part in enumerate((BASE, TAG, NOTICE, NAME, MENTION)) for line in part.strip().splitlines()]
    rules = []
    for number, (kind, line) in enumerate(lines):
        label, before, keyword, after = _LINE.fullmatch(line).groups()
        rules.append(Rule(number, kind, label, keyword, before, after))
    return rules


RULES = _parsed()
