"""The ordered signature rules of license scans: hand-written, one regex a line.

Fields: priority (1 an identifier or a body's own words, 2 a notice, 3 a name, 4 a weak hint), label, keyword (a literal
that every match holds), and a regex over lower-cased words with single blanks between.
"""

#: Fixed values.
SIGNATURES = """
1 :: 0bsd :: 0bsd :: spdx license identifier 0bsd
1 :: 0bsd :: notice or this permission :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided that the above)(?: [^ ]+){0,3} notice or this permission
2 :: 0bsd :: zero clause :: licen[cs]ed under (?:the )?(?:zero clause bsd|bsd zero clause)(?: license)?
2 :: 0bsd :: 0bsd :: licen[cs]ed under (?:the )?0bsd(?: license)?
3 :: 0bsd :: zero clause :: (?:bsd zero clause|zero clause bsd)(?: license)?
3 :: 0bsd :: 0bsd :: 0bsd license
3 :: 0bsd :: free public license :: free public license(?: 1 0 0)?
1 :: afl :: afl :: spdx license identifier afl (?:1 [12]|2 [01]|3 0)
1 :: afl :: academic free :: licensed under the academic free license(?: version)?(?: [0-9] [0-9])?
3 :: afl :: academic free :: academic free license(?: v ?[0-9] [0-9]| version [0-9] [0-9])?
3 :: afl :: afl :: afl (?:version |v )?[123] [01]
1 :: agpl :: agpl :: spdx license identifier agpl [13] 0(?: only| or later)?
1 :: agpl :: affero :: under the terms of the gnu affero general public license as published by the free software foundation
1 :: agpl :: affero :: gnu affero general public license is a free copyleft license
1 :: agpl :: remotely through :: interacting with it remotely through a computer network
1 :: agpl :: remote network :: remote network interaction use with the gnu general public license
2 :: agpl :: affero :: (?:licen[cs]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?affero general public license(?: v(?:ersion)? ?[0-9])?
3 :: agpl :: affero :: (?:gnu )?affero (?:general public license|gpl)(?: v(?:ersion)? ?[0-9](?: [0-9])?)?
3 :: agpl :: agpl :: (?:gnu )?agpl(?: v3| 3 0| version 3)(?: license)?
3 :: agpl :: agplv3 :: (?:gnu )?agplv3(?: license)?
1 :: apache :: apache :: spdx license identifier apache (?:1 [01]|2 0)
1 :: apache :: apache license :: apache license version 2 0 january 2004
1 :: apache :: apache license :: licensed under the apache license version 2 0 the license
1 :: apache :: compliance :: you may not use this file except in compliance with the license
1 :: apache :: applicable law :: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
1 :: apache :: patent license :: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license
1 :: apache :: apache software foundation :: licensed to the apache software foundation asf under one or more contributor license agreements
1 :: apache :: developed by the apache :: this product includes software developed by the apache (?:software foundation|group)
2 :: apache :: apache :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |an )?apache(?: software)?(?: license)?(?: v(?:ersion)? ?[12](?: [01])?| [12] [01])?
3 :: apache :: apache :: apache (?:software )?license(?: v(?:ersion)? ?[12](?: [01])?| [12] [01])?
3 :: apache :: apache :: apache (?:2 0|1 1|1 0|2)(?: licensed?)?
3 :: apache :: apache org licenses :: (?:www )?apache org licenses(?: license [12] [01])?
3 :: apache :: asl :: asl 2 0
1 :: apsl :: apsl :: spdx license identifier apsl [12] [012]
1 :: apsl :: apple public source :: contains original code and or modifications of original code as defined in and that are subject to the apple public source license
3 :: apsl :: apple public source :: apple public source license(?: version)?(?: [12] [012])?
3 :: apsl :: apsl :: apsl(?: v)? [12] [012]
1 :: artistic :: artistic :: spdx license identifier artistic [12] 0(?: perl| cl8)?
1 :: artistic :: artistic control :: maintains some semblance of artistic control over the development of the package
1 :: artistic :: verbatim copies :: you may make and give away verbatim copies of the source form of the standard version
2 :: artistic :: artistic :: (?:licen[cs]ed|released|distributed|available) under (?:the terms of )?(?:the )?(?:perl )?artistic license(?: [12] 0)?
2 :: artistic :: terms as perl :: under the same terms as perl(?: itself)?
3 :: artistic :: artistic :: (?:perl |clarified )?artistic license(?: version)?(?: [12] 0)?
1 :: blueoak :: blueoak :: spdx license identifier blueoak 1 0 0
1 :: blueoak :: much permission :: this license gives everyone as much permission to work with this software as possible
3 :: blueoak :: blue oak :: blue oak model license(?: version)?(?: 1 0 0)?
1 :: bsd :: bsd :: spdx license identifier bsd [1234] clause(?: [a-z]+)*
1 :: bsd :: redistribution and use :: redistribution and use in source and binary forms with or without modification(?: are permitted)?
1 :: bsd :: redistributions of source :: redistributions of source code must retain the (?:above )?copyright notice
1 :: bsd :: redistributions in binary :: redistributions in binary form must reproduce the above copyright notice
1 :: bsd :: endorse or promote :: (?:neither the name of|the names? of)(?: [^ ]+){1,15} may (?:not )?be used to endorse or promote products derived from this software
1 :: bsd :: advertising :: all advertising materials mentioning features or use of this software must display
1 :: bsd :: regents :: copyright(?: c)?(?: [^ ]+){0,8} (?:the )?regents of the university of california
2 :: bsd :: bsd :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a )?(?:new |modified |simplified |revised |[1234] clause )?bsd(?: style)?(?: license)?
2 :: bsd :: bsd style :: governed by a bsd style license(?: that can be found in the license file)?
3 :: bsd :: bsd :: (?:new |modified |simplified |revised |original |[1234] clause |two clause |three clause )?bsd licen[cs]ed?
3 :: bsd :: bsd :: bsd (?:[1234]|two|three|four) clause(?: license)?
3 :: bsd :: freebsd :: freebsd (?:license|copyright)
1 :: bsl :: bsl :: spdx license identifier bsl 1 0
1 :: bsl :: boost software :: boost software license version 1 0(?: august 17th 2003)?
1 :: bsl :: obtaining a copy :: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
2 :: bsl :: boost software :: distributed under the boost software license(?: version 1 0)?
3 :: bsl :: boost :: boost (?:software )?license
3 :: bsl :: boost org :: (?:www )?boost org license 1 0 txt
1 :: busl :: busl :: spdx license identifier busl 1 1
1 :: busl :: non production :: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
3 :: busl :: business source :: business source license(?: 1 1)?
3 :: busl :: change license :: change date(?: [^ ]+){1,8} change license
1 :: cc-by :: cc by :: spdx license identifier cc by [1234] [05](?: [a-z]{2})?
2 :: cc-by :: creative commons :: licensed under (?:a |the )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by :: creative commons :: creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by :: cc by :: cc by(?: [1234] [05])?
3 :: cc-by :: licenses by :: creativecommons org licenses by [1234] [05]
1 :: cc-by-nc :: cc by nc :: spdx license identifier cc by nc [1234] [05]
2 :: cc-by-nc :: creative commons :: licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc :: creative commons :: creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc :: cc by nc :: cc by nc(?: [1234] [05])?
3 :: cc-by-nc :: licenses by nc :: creativecommons org licenses by nc [1234] [05]
1 :: cc-by-nc-nd :: cc by nc nd :: spdx license identifier cc by nc nd [1234] [05]
2 :: cc-by-nc-nd :: creative commons :: licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc-nd :: creative commons :: creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc-nd :: cc by nc nd :: cc by nc nd(?: [1234] [05])?
3 :: cc-by-nc-nd :: licenses by nc nd :: creativecommons org licenses by nc nd [1234] [05]
1 :: cc-by-nc-sa :: cc by nc sa :: spdx license identifier cc by nc sa [1234] [05]
2 :: cc-by-nc-sa :: creative commons :: licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc-sa :: creative commons :: creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nc-sa :: cc by nc sa :: cc by nc sa(?: [1234] [05])?
3 :: cc-by-nc-sa :: licenses by nc sa :: creativecommons org licenses by nc sa [1234] [05]
1 :: cc-by-nd :: cc by nd :: spdx license identifier cc by nd [1234] [05]
3 :: cc-by-nd :: creative commons :: creative commons attribution no ?deriv(?:ative|atives|s)?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-nd :: cc by nd :: cc by nd(?: [1234] [05])?
3 :: cc-by-nd :: licenses by nd :: creativecommons org licenses by nd [1234] [05]
1 :: cc-by-sa :: cc by sa :: spdx license identifier cc by sa [1234] [05]
2 :: cc-by-sa :: creative commons :: licensed under (?:a |the )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-sa :: creative commons :: creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)? license
3 :: cc-by-sa :: cc by sa :: cc by sa(?: [1234] [05])?
3 :: cc-by-sa :: licenses by sa :: creativecommons org licenses by sa [1234] [05]
1 :: cc0 :: cc0 :: spdx license identifier cc0 1 0
1 :: cc0 :: dedicated the work :: the person who associated a work with this deed has dedicated the work to the public domain
1 :: cc0 :: statement of purpose :: statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright
3 :: cc0 :: cc0 :: (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication| license)?
3 :: cc0 :: commons zero :: creative commons zero(?: v ?1 0)?(?: universal)?
3 :: cc0 :: publicdomain zero :: creativecommons org publicdomain zero 1 0
1 :: cddl :: cddl :: spdx license identifier cddl 1 [01]
1 :: cddl :: common development :: subject to the terms of the common development and distribution license(?: the license)?
3 :: cddl :: common development :: common development and distribution license(?: version)?(?: 1 [01])?(?: cddl)?
3 :: cddl :: cddl :: cddl(?: v)?(?: 1 [01])?
1 :: cecill :: cecill :: spdx license identifier cecill (?:[12] [01]|b|c)
2 :: cecill :: cecill :: governed by the cecill(?: [abc])? license under french law
3 :: cecill :: cecill :: cecill(?: v ?[12](?: [01])?| [abc])?(?: free software)?(?: license)?(?: agreement)?
1 :: cpal :: cpal :: spdx license identifier cpal 1 0
1 :: cpal :: common public attribution :: subject to the common public attribution license version 1 0
3 :: cpal :: common public attribution :: common public attribution license(?: version)?(?: 1 0)?
1 :: cpl :: cpl :: spdx license identifier cpl 1 0
1 :: cpl :: common public license :: the accompanying program is provided under the terms of this common public license
3 :: cpl :: common public license :: common public license(?: version| v)?(?: 1 0| 0 5)?
1 :: ecl :: ecl :: spdx license identifier ecl [12] 0
1 :: ecl :: educational community :: licensed under the educational community license version 2 0
3 :: ecl :: educational community :: educational community license(?: version)?(?: [12] 0)?
1 :: elastic :: elastic :: spdx license identifier elastic 2 0
1 :: elastic :: hosted or managed :: you may not provide the software to third parties as a hosted or managed service
3 :: elastic :: elastic license :: elastic license(?: 2 0| v2| version 2)?
1 :: epl :: epl :: spdx license identifier epl [12] 0
1 :: epl :: eclipse public :: this program and the accompanying materials are made available under the terms of the eclipse public license(?: v ?[12](?: 0)?)?
1 :: epl :: accompanying program :: the accompanying program is provided under the terms of this eclipse public license agreement
3 :: epl :: eclipse public :: eclipse public license(?: version| v)?(?: [12] 0)?
3 :: epl :: eclipse org legal :: (?:www )?eclipse org legal epl (?:v10|v20|2 0) html
1 :: eupl :: eupl :: spdx license identifier eupl 1 [012]
1 :: eupl :: european union public :: licen[cs]ed under the eupl(?: version)?(?: 1 [012])?(?: [^ ]+){0,6} european union public licen[cs]e
3 :: eupl :: european union public :: european union public licen[cs]e(?: v| version)?(?: ?1 [012])?
3 :: eupl :: eupl :: eupl(?: v)?(?: 1 [012])?
1 :: gfdl :: gfdl :: spdx license identifier gfdl 1 [123](?: only| or later)?
1 :: gfdl :: free documentation :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 :: gfdl :: invariant sections :: with no invariant sections no front cover texts and no back cover texts
3 :: gfdl :: free documentation :: (?:gnu )?free documentation license(?: version)?(?: 1 [123])?
1 :: gpl :: gpl :: spdx license identifier gpl [123] 0(?: only| or later)?
1 :: gpl :: general public license :: under the terms of the gnu general public license(?: version [23])? as published by the free software foundation
1 :: gpl :: general public license :: you should have received a copy of the gnu general public license along with this program
1 :: gpl :: general public license :: see the gnu general public license for more details
1 :: gpl :: at your option :: either version [23](?: of the license)? or at your option any later version
1 :: gpl :: fitness :: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
1 :: gpl :: verbatim copies :: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
1 :: gpl :: freedom to share :: the licenses for most software are designed to take away your freedom to share and change it
2 :: gpl :: general public license :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?general public license(?: v(?:ersion)? ?[123](?: 0)?)?
2 :: gpl :: gpl :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?gpl(?: v(?:ersion)? ?[123](?: 0)?)?
2 :: gpl :: gplv2 :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?gplv2
2 :: gpl :: gplv3 :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?gplv3
3 :: gpl :: general public license :: (?:gnu )?general public license(?: v(?:ersion)? ?[123](?: 0)?| [123] 0)?
3 :: gpl :: gpl :: (?:gnu )?gpl(?: v(?:ersion)? ?[123]| [23] 0| license)
3 :: gpl :: gplv2 :: (?:gnu )?gplv2(?: license)?
3 :: gpl :: gplv3 :: (?:gnu )?gplv3(?: license)?
3 :: gpl :: gnu org :: (?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?
1 :: hpnd :: hpnd :: spdx license identifier hpnd
1 :: hpnd :: its documentation :: permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted
3 :: hpnd :: historical permission :: historical permission notice and disclaimer
1 :: isc :: isc :: spdx license identifier isc
1 :: isc :: permission to use :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
2 :: isc :: isc :: (?:licen[cs]ed|released|distributed|available) under (?:the terms of )?(?:the )?isc(?: license)?
3 :: isc :: isc :: isc licen[cs]ed?
1 :: lgpl :: lgpl :: spdx license identifier lgpl [23] [01](?: only| or later)?
1 :: lgpl :: general public license :: under the terms of the gnu (?:lesser|library) general public license(?: version [23](?: 1)?)? as published by the free software foundation
1 :: lgpl :: general public license :: you should have received a copy of the gnu (?:lesser|library) general public license
1 :: lgpl :: additional permissions :: incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions
2 :: lgpl :: general public license :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public license(?: v(?:ersion)? ?[23](?: [01])?)?
2 :: lgpl :: lgpl :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?lgpl(?: v(?:ersion)? ?[23](?: [01])?)?
2 :: lgpl :: lgplv2 :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?lgplv2
2 :: lgpl :: lgplv3 :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the )?(?:gnu )?lgplv3
3 :: lgpl :: general public license :: (?:gnu )?(?:lesser|library) general public license(?: v(?:ersion)? ?[23](?: [01])?| [23] [01])?
3 :: lgpl :: lgpl :: (?:gnu )?lgpl(?: v(?:ersion)? ?[23]| [23] [01]| license)?
3 :: lgpl :: lgplv2 :: (?:gnu )?lgplv2(?: license)?
3 :: lgpl :: lgplv3 :: (?:gnu )?lgplv3(?: license)?
3 :: lgpl :: gnu org :: (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
1 :: lppl :: lppl :: spdx license identifier lppl 1 [0123][ac]?
1 :: lppl :: latex project :: this work may be distributed and or modified under the conditions of the latex project public license
3 :: lppl :: latex project :: latex project public license(?: version)?(?: 1 [0123][ac]?)?
3 :: lppl :: lppl :: lppl(?: 1 [0123][ac]?)?
1 :: mit :: mit :: spdx license identifier mit
1 :: mit :: permission is hereby :: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 :: mit :: permission notice :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 :: mit :: without restriction :: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
1 :: mit :: authors or copyright :: in no event shall the authors or copyright holders be liable for any claim damages or other liability
2 :: mit :: mit :: (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |an )?mit(?: style| x11)?(?: license)?
3 :: mit :: mit :: mit(?: style| x11)? licen[cs]ed?
3 :: mit :: mit :: license(?: is)? mit
3 :: mit :: expat :: expat licen[cs]e
3 :: mit :: x11 :: x11 licen[cs]e
3 :: mit :: opensource org :: (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
1 :: mit-0 :: mit 0 :: spdx license identifier mit 0
3 :: mit-0 :: no attribution :: mit no attribution(?: license)?
3 :: mit-0 :: mit 0 :: mit 0(?: license)?
1 :: mpl :: mpl :: spdx license identifier mpl [12] [01](?: no copyleft exception)?
1 :: mpl :: mozilla public :: this source code form is subject to the terms of the mozilla public license(?: v ?2 0)?
1 :: mpl :: mozilla public :: the contents of this file are subject to the mozilla public license version 1 [01]
1 :: mpl :: mozilla org mpl :: you can obtain one at https? (?:www )?mozilla org mpl 2 0
2 :: mpl :: mozilla public :: (?:licen[cs]ed|released|distributed|available) under (?:the terms of )?(?:the )?mozilla public license(?: v(?:ersion)? ?[12](?: [01])?)?
3 :: mpl :: mozilla public :: mozilla public license(?: v(?:ersion)? ?[12](?: [01])?| [12] [01])?
3 :: mpl :: mpl :: mpl(?: v(?:ersion)?)? [12] [01]
1 :: ms-pl :: ms pl :: spdx license identifier ms pl
1 :: ms-pl :: accompanying software :: this license governs use of the accompanying software if you use the software you accept this license
3 :: ms-pl :: microsoft public :: microsoft public license(?: ms pl)?
3 :: ms-pl :: ms pl :: ms pl
1 :: ms-rl :: ms rl :: spdx license identifier ms rl
3 :: ms-rl :: microsoft reciprocal :: microsoft reciprocal license(?: ms rl)?
3 :: ms-rl :: ms rl :: ms rl
1 :: mulan :: mulanpsl :: spdx license identifier mulanpsl [12] 0
1 :: mulan :: mulan psl :: licensed under (?:the )?mulan psl v[12]
3 :: mulan :: mulan permissive :: mulan permissive software license(?: v ?[12])?
1 :: ncsa :: ncsa :: spdx license identifier ncsa
1 :: ncsa :: without restriction :: to deal with the software without restriction including without limitation the rights to use
3 :: ncsa :: ncsa :: (?:university of illinois )?ncsa(?: open source)? license
1 :: odbl :: odbl :: spdx license identifier odbl 1 0
1 :: odbl :: open database :: is made available under the open database license
3 :: odbl :: database license :: open (?:data commons open )?database license(?: v ?1 0)?
3 :: odbl :: odbl :: odbl(?: v?1 0)?
1 :: odc-by :: odc by :: spdx license identifier odc by 1 0
1 :: odc-by :: open data commons :: is made available under the open data commons attribution license
3 :: odc-by :: open data commons :: open data commons attribution license(?: v ?1 0)?
1 :: ofl :: ofl :: spdx license identifier ofl 1 [01](?: rfn| no rfn)?
1 :: ofl :: open font :: this font software is licensed under the sil open font license version 1 1
1 :: ofl :: reserved font :: with reserved font names?
3 :: ofl :: open font :: (?:sil )?open font license(?: version| v)?(?: ?1 [01])?
1 :: openssl :: openssl :: spdx license identifier openssl
1 :: openssl :: openssl :: this product includes software developed by the openssl project for use in the openssl toolkit
1 :: openssl :: eric young :: this product includes cryptographic software written by eric young
3 :: openssl :: openssl :: openssl(?: ssleay)? license
1 :: osl :: osl :: spdx license identifier osl [123] [01]
1 :: osl :: open software license :: licensed under the open software license version [123] [01]
3 :: osl :: open software license :: open software license(?: version| v)?(?: [123] [01])?
1 :: php :: php :: spdx license identifier php 3 01?
1 :: php :: php license :: this source file is subject to version [23] 0?[01]? ?of the php license
1 :: php :: php software :: this product includes php software freely available from
3 :: php :: php license :: php license(?: version| v)?(?: [23] 01?)?
1 :: postgresql :: postgresql :: spdx license identifier postgresql
1 :: postgresql :: written agreement :: without fee and without a written agreement is hereby granted
3 :: postgresql :: postgresql :: postgresql licen[cs]e
1 :: psf :: psf :: spdx license identifier psf 2 0
1 :: psf :: python 2 0 :: spdx license identifier python 2 0(?: 1)?
1 :: psf :: python software foundation :: this license agreement is between the python software foundation psf and the individual or organization
3 :: psf :: python software foundation :: python software foundation license(?: version)?(?: 2)?
1 :: ruby :: ruby :: spdx license identifier ruby
2 :: ruby :: ruby :: (?:licen[cs]ed|released|distributed|available) under the same terms as ruby(?: itself)?
3 :: ruby :: ruby :: (?:the )?ruby licen[cs]e
1 :: sspl :: sspl :: spdx license identifier sspl 1 0
1 :: sspl :: network download :: you must make the service source code available via network download to everyone at no charge
3 :: sspl :: server side public :: server side public license(?: v(?:ersion)? ?1)?
3 :: sspl :: sspl :: sspl(?: v ?1| 1 0)?
1 :: unlicense :: unlicense :: spdx license identifier unlicense
1 :: unlicense :: unencumbered :: this is free and unencumbered software released into the public domain
1 :: unlicense :: anyone is free :: anyone is free to copy modify publish use compile sell or distribute this software
3 :: unlicense :: unlicense :: (?:the )?unlicense
1 :: upl :: upl :: spdx license identifier upl 1 0
1 :: upl :: freely licensable :: any and all copyright rights owned or freely licensable by each licensor hereunder
3 :: upl :: universal permissive :: universal permissive license(?: version| v)?(?: ?1 0)?
1 :: vim :: vim :: spdx license identifier vim
1 :: vim :: copies of vim :: there are no restrictions on distributing unmodified copies of vim
3 :: vim :: vim license :: (?:the )?vim license
1 :: w3c :: w3c :: spdx license identifier w3c(?: 19980720| 20150513)?
3 :: w3c :: w3c :: w3c software(?: and document)?(?: notice and)? license
1 :: wtfpl :: wtfpl :: spdx license identifier wtfpl
1 :: wtfpl :: fuck :: you just do what the fuck you want to
3 :: wtfpl :: want to public :: do what the fuck you want to public license
3 :: wtfpl :: wtfpl :: wtfpl(?: v?2)?
1 :: zlib :: zlib :: spdx license identifier zlib
1 :: zlib :: implied warranty :: this software is provided as is without any express or implied warranty in no event will the authors be held liable
1 :: zlib :: misrepresented :: the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 :: zlib :: altered source :: altered source versions must be plainly marked as such
3 :: zlib :: zlib :: zlib(?: libpng)? licen[cs]e
3 :: public-domain :: public domain :: (?:released|placed|dedicated|put) (?:in|into|to) the public domain
4 :: public-domain :: public domain :: public domain
4 :: proprietary :: rights reserved :: all rights reserved
4 :: proprietary :: proprietary :: (?:proprietary and confidential|confidential and proprietary)
4 :: proprietary :: unauthorized copying :: unauthorized copying of this file(?: via any medium)? is strictly prohibited
4 :: proprietary :: license terms :: use of this software is subject to license terms
"""
