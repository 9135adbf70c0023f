"""Signature rules: priority, label, keyword, and a regex over lower-cased words with single spaces between them.

Priority 1: machine-readable tags and the licence's own distinctive text; 2: a name with a version or variant; 3: a
licence's name; 4: a hint. A rule is tried only on texts that hold its keyword as a word.
"""

from __future__ import annotations

# The rules below are fixed values written by hand, in order of priority within each family.
_RULES = r"""
1 gpl-3.0 spdx spdx license identifier gpl 3 0( only| or later)?
1 gpl-2.0 spdx spdx license identifier gpl 2 0( only| or later)?
1 lgpl-3.0 spdx spdx license identifier lgpl 3 0( only| or later)?
1 lgpl-2.1 spdx spdx license identifier lgpl 2 1( only| or later)?
1 agpl-3.0 spdx spdx license identifier agpl 3 0( only| or later)?
1 mit spdx spdx license identifier mit
1 apache-2.0 spdx spdx license identifier apache 2 0
1 bsd-2-clause spdx spdx license identifier bsd 2 clause
1 bsd-3-clause spdx spdx license identifier bsd 3 clause
1 isc spdx spdx license identifier isc
1 mpl-2.0 spdx spdx license identifier mpl 2 0
1 epl-2.0 spdx spdx license identifier epl 2 0
1 epl-1.0 spdx spdx license identifier epl 1 0
1 cddl-1.0 spdx spdx license identifier cddl 1 0
1 unlicense spdx spdx license identifier unlicense
1 cc0-1.0 spdx spdx license identifier cc0 1 0
1 cc-by-4.0 spdx spdx license identifier cc by 4 0
1 cc-by-sa-4.0 spdx spdx license identifier cc by sa 4 0
1 cc-by-nc-4.0 spdx spdx license identifier cc by nc 4 0
1 bsl-1.0 spdx spdx license identifier bsl 1 0
1 zlib spdx spdx license identifier zlib
1 wtfpl spdx spdx license identifier wtfpl
1 0bsd spdx spdx license identifier 0bsd
1 gpl gnu this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1 lgpl gnu this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
1 mit permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 isc permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted
1 bsd-3-clause endorse neither the name of( [^ ]+){1,12} may be used to endorse or promote products
1 unlicense unencumbered this is free and unencumbered software released into the public domain
1 boost permission permission is hereby granted free of charge to any person or organization obtaining a copy of the software
1 zlib misrepresented the origin of this software must not be misrepresented
1 wtfpl fuck you just do what the fuck you want to
2 gpl-3.0 gnu gnu general public license( as published by the free software foundation)?( either)?( version| v) ?3( 0)?
2 gpl-2.0 gnu gnu general public license( as published by the free software foundation)?( either)?( version| v) ?2( 0)?
2 gpl-1.0 gnu gnu general public license( version| v) ?1( 0)?
2 gpl-3.0 gpl gpl( version)? ?v?3( 0)?( only| or later)?
2 gpl-3.0 gplv3 gplv3( only| or later)?
2 gpl-2.0 gpl gpl( version)? ?v?2( 0)?( only| or later)?
2 gpl-2.0 gplv2 gplv2( only| or later)?
2 lgpl-3.0 gnu gnu lesser general public license( version| v) ?3( 0)?
2 lgpl-2.1 gnu gnu lesser general public license( version| v) ?2 1
2 lgpl-2.0 gnu gnu library general public license( version| v) ?2( 0)?
2 lgpl-3.0 lgpl lgpl( version)? ?v?3( 0)?
2 lgpl-2.1 lgpl lgpl( version)? ?v?2 1
2 lgpl-3.0 lgplv3 lgplv3
2 agpl-3.0 gnu gnu affero general public license( version| v) ?3( 0)?
2 agpl-3.0 agpl agpl( version)? ?v?3( 0)?
2 agpl-3.0 agplv3 agplv3
2 gfdl-1.3 gnu gnu free documentation license( version)? 1 3
2 gfdl-1.2 gnu gnu free documentation license( version)? 1 2
2 gfdl-1.1 gnu gnu free documentation license( version)? 1 1
2 apache-2.0 apache apache license( version| v)? ?2( 0)?
2 apache-1.1 apache apache (software )?license( version)? 1 1
2 apache-1.0 apache apache (software )?license( version)? 1 0
2 apache-2.0 apache apache 2( 0)?( license)?
2 mpl-2.0 mozilla mozilla public license( version| v)? ?2 0
2 mpl-1.1 mozilla mozilla public license( version| v)? ?1 1
2 mpl-1.0 mozilla mozilla public license( version| v)? ?1 0
2 mpl-2.0 mpl mpl( version)? ?v?2 0
2 mpl-1.1 mpl mpl( version)? ?v?1 1
2 epl-2.0 eclipse eclipse public license( version| v)? ?2 0
2 epl-1.0 eclipse eclipse public license( version| v)? ?1 0
2 epl-2.0 epl epl( version)? ?v?2 0
2 epl-1.0 epl epl( version)? ?v?1 0
2 edl-1.0 eclipse eclipse distribution license( version| v)? ?1 0
2 cddl-1.1 cddl cddl( version)? ?1 1
2 cddl-1.0 cddl cddl( version)? ?1 0
2 cddl-1.0 distribution common development and distribution license( version)? 1 0
2 cddl-1.1 distribution common development and distribution license( version)? 1 1
2 cpl-1.0 common common public license( version)? 1 0
2 bsd-2-clause bsd (bsd 2 clause|2 clause bsd|simplified bsd)( license)?
2 bsd-3-clause bsd (bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( license)?
2 bsd-4-clause bsd (bsd 4 clause|4 clause bsd|original bsd|old bsd)( license)?
2 0bsd bsd (zero clause bsd|bsd zero clause|0 clause bsd)( license)?
2 cc-by-nc-nd-4.0 cc cc by nc nd 4 0( international)?
2 cc-by-nc-nd-3.0 cc cc by nc nd 3 0( unported)?
2 cc-by-nc-nd cc cc by nc nd
2 cc-by-nc-sa-4.0 cc cc by nc sa 4 0( international)?
2 cc-by-nc-sa-3.0 cc cc by nc sa 3 0( unported)?
2 cc-by-nc-sa-2.5 cc cc by nc sa 2 5
2 cc-by-nc-sa cc cc by nc sa
2 cc-by-nc-4.0 cc cc by nc 4 0( international)?
2 cc-by-nc-3.0 cc cc by nc 3 0( unported)?
2 cc-by-nc cc cc by nc
2 cc-by-nd-4.0 cc cc by nd 4 0( international)?
2 cc-by-nd-3.0 cc cc by nd 3 0( unported)?
2 cc-by-nd cc cc by nd
2 cc-by-sa-4.0 cc cc by sa 4 0( international)?
2 cc-by-sa-3.0 cc cc by sa 3 0( unported)?
2 cc-by-sa-2.5 cc cc by sa 2 5
2 cc-by-sa-2.0 cc cc by sa 2 0
2 cc-by-sa cc cc by sa
2 cc-by-4.0 cc cc by 4 0( international)?
2 cc-by-3.0 cc cc by 3 0( unported)?
2 cc-by-2.5 cc cc by 2 5
2 cc-by-2.0 cc cc by 2 0
2 cc-by-4.0 commons creative commons attribution 4 0( international)?( public)?( license)?
2 cc-by-3.0 commons creative commons attribution 3 0( unported)?( license)?
2 cc-by-sa-4.0 commons creative commons attribution share ?alike 4 0( international)?( license)?
2 cc-by-sa-3.0 commons creative commons attribution share ?alike 3 0( unported)?( license)?
2 cc-by-nc-4.0 commons creative commons attribution non ?commercial 4 0( international)?( license)?
2 cc-by-nc-3.0 commons creative commons attribution non ?commercial 3 0( unported)?( license)?
2 cc-by-nc-sa-4.0 commons creative commons attribution non ?commercial share ?alike 4 0( international)?( license)?
2 cc-by-nc-nd-4.0 commons creative commons attribution non ?commercial no ?deriv(s|atives) 4 0( international)?( license)?
2 cc-by-nd-4.0 commons creative commons attribution no ?deriv(s|atives) 4 0( international)?( license)?
2 cc-by-4.0 creativecommons creativecommons org licenses by 4 0
2 cc-by-3.0 creativecommons creativecommons org licenses by 3 0
2 cc-by-sa-4.0 creativecommons creativecommons org licenses by sa 4 0
2 cc-by-sa-3.0 creativecommons creativecommons org licenses by sa 3 0
2 cc-by-nc-4.0 creativecommons creativecommons org licenses by nc 4 0
2 cc-by-nc-sa-4.0 creativecommons creativecommons org licenses by nc sa 4 0
2 cc-by-nc-nd-4.0 creativecommons creativecommons org licenses by nc nd 4 0
2 cc-by-nd-4.0 creativecommons creativecommons org licenses by nd 4 0
2 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
2 cc0-1.0 cc0 cc0( 1 0)?( universal)?
2 cc0-1.0 zero (creative commons|cc) zero( 1 0)?( universal)?
2 pddl-1.0 commons open data commons public domain dedication( and license)?
2 odbl-1.0 database open database license( v?1 0)?
2 odbl-1.0 odbl odbl( 1 0)?
2 odc-by-1.0 commons open data commons attribution license
2 ogl-3.0 government open government licence( v| version) ?3( 0)?
2 ogl-2.0 government open government licence( v| version) ?2( 0)?
2 eupl-1.2 eupl eupl( v| version)? ?1 2
2 eupl-1.1 eupl eupl( v| version)? ?1 1
2 eupl-1.2 european european union public licen[cs]e( v| version)? ?1 2
2 osl-3.0 open open software license( v| version)? ?3 0
2 afl-3.0 academic academic free license( v| version)? ?3 0
2 artistic-2.0 artistic artistic license 2 0
2 artistic-1.0 artistic artistic license 1 0
2 bsl-1.0 boost boost software license( version)? 1 0
2 busl-1.1 business business source license( version)? 1 1
2 sspl-1.0 server server side public license( v| version)? ?1?
2 elastic-2.0 elastic elastic license( v| version)? ?2( 0)?
2 polyform-nc-1.0 polyform polyform noncommercial license( 1 0 0)?
2 polyform-sb-1.0 polyform polyform small business license( 1 0 0)?
2 ofl-1.1 sil sil open font license( version)? 1 1
2 ofl-1.0 sil sil open font license( version)? 1 0
2 python-2.0 python python software foundation license( version)? 2
2 php-3.01 php php license( version)? 3 01
2 php-3.0 php php license( version)? 3 0
2 zpl-2.1 zope zope public license( version)? 2 1
2 zpl-2.0 zope zope public license( version)? 2 0
2 ms-pl microsoft microsoft public license
2 ms-rl microsoft microsoft reciprocal license
2 apsl-2.0 apple apple public source license( version)? 2 0
2 ipl-1.0 ibm ibm public license( version)? 1 0
2 cecill-2.1 cecill cecill( free software license)?( agreement)?( version)? ?2 1
2 cecill-b cecill cecill b
2 cecill-c cecill cecill c
2 ncsa illinois university of illinois( ncsa)? open source license
2 upl-1.0 universal universal permissive license( v)? ?1 0
2 openrail-m openrail openrail m
2 llama llama llama [0-9]( [0-9])? community license
2 rail rail (bigscience )?(open )?rail( m)? license
3 gpl gnu gnu general public licen[cs]e
3 gpl gnu gnu gpl
3 gpl gpl (licensed|released|distributed|available) under( the)? gpl
3 lgpl gnu gnu (lesser|library) general public licen[cs]e
3 lgpl lgpl lgpl
3 agpl gnu gnu affero general public licen[cs]e
3 agpl agpl agpl
3 gfdl gnu gnu free documentation licen[cs]e
3 gfdl gfdl gfdl
3 apache apache apache( software)? licen[cs]e
3 mit mit (the )?mit licen[cs]e
3 mit mit (licensed|released|distributed|available) under( the)? mit
3 mit expat expat licen[cs]e
3 x11 x11 x11 licen[cs]e
3 bsd bsd bsd( style)? licen[cs]e
3 isc isc isc licen[cs]e
3 mpl mozilla mozilla public licen[cs]e
3 epl eclipse eclipse public licen[cs]e
3 cddl cddl cddl
3 cc-by cc cc by
3 cc-by commons creative commons attribution( licen[cs]e)?
3 cc-by-sa commons creative commons attribution share ?alike( licen[cs]e)?
3 cc-by-nc commons creative commons attribution non ?commercial( licen[cs]e)?
3 unlicense unlicense (the )?unlicense
3 wtfpl wtfpl wtfpl
3 zlib zlib zlib( libpng)? licen[cs]e
3 libpng libpng libpng licen[cs]e
3 openssl openssl openssl licen[cs]e
3 curl curl curl licen[cs]e
3 postgresql postgresql postgresql licen[cs]e
3 python python python software foundation licen[cs]e
3 ruby ruby ruby licen[cs]e
3 perl perl (same terms as|under the terms of) perl( itself)?
3 artistic artistic artistic licen[cs]e
3 vim vim vim licen[cs]e
3 w3c w3c w3c( software)? (licen[cs]e|notice and license)
3 ofl sil sil open font licen[cs]e
3 ogl government open government licen[cs]e
3 eupl european european union public licen[cs]e
3 bsl boost boost software licen[cs]e
3 sspl sspl sspl
3 beerware beerware beerware( licen[cs]e)?
3 jquery jquery jquery licen[cs]e
4 public-domain public (in|into|to) the public domain
4 public-domain public public domain dedication
4 all-rights-reserved rights all rights reserved
4 proprietary proprietary (proprietary and confidential|proprietary licen[cs]e)
4 commercial commercial (commercial licen[cs]e|not for commercial use|non commercial use only)
4 copyleft copyleft copyleft
4 permissive permissive permissive licen[cs]e
4 creative-commons commons creative commons( licen[cs]e)?
4 open-source open open source licen[cs]e
"""

RULES = [(int(p), label, word, regex) for p, label, word, regex in (line.split(" ", 3) for line in _RULES.strip().splitlines())]
KEYWORDS = sorted({r[2] for r in RULES})
