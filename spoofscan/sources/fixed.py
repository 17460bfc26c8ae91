"""Values that follow Unicode 18 where the ICU library of a session is older, in code point order. Fixed values.

They are facts of the Unicode Character Database and UTS #39 (Unicode License v3, see NOTICE). Each table holds under 200
entries; what is larger comes from a rule (see unicode.py) or from a folder of Unicode's own files (see folder.py).
"""

#: The version that these values follow.
FOLLOWS = 18
#: Look-alike prototypes: of characters below U+0600, Arabic and Devanagari letters, a conjoining Hangul letter, CJK radicals, and
#: ideographs up to U+52FF and others that these lead to. A character that has itself is its own.
PROTOTYPES = {
    "%": "°/₀", "¡": "i", "\xa6": "\u208f", "²": "ᒾ", "¹": "ᣳ", "º": "°", "¼": "l/4", "½": "l/2", "¾": "3/4", "þ": "p",
    "Ŀ": "L·", "\u014b": "n\u0329", "\u018b": "d\u0304", "ƒ": "f", "\u01ab": "t\u0326", "ƿ": "p", "\u01c4": "DZ\u0306",
    "\u01c5": "Dz\u0306", "\u01c6": "dz\u0306", "ȷ": "j", "ȹ": "ɸ", "Ɍ": "R", "\u025f": "j\u0335", "\u0272": "n\u0326",
    "\u0279": "\U0001df70", "ʄ": "f", "\u0295": "\ua7ce", "\u02a9": "fn\u0329", "ʲ": "𞁍", "ʸ": "𞁁", "ˑ": "·", "˛": "˛",
    "ˣ": "𞁃", "˭": "ᙿ", "\u0309": "\u0350", "\u030b": "\u0301\u0301", "\u030d": "\u0e48", "\u031a": "\u1ae9",
    "\u032e": "\U00011b62", "\u0348": "\U00010efa", "\u0365": "\U0001e08f", "ͺ": "˛", "Ϥ": "Ч", "ϥ": "ч", "Ϭ": "6", "ϭ": "o",
    "ϸ": "p", "ш": "w", "\u045f": "u\u0329", "Ѹ": "Oy", "ѹ": "oy", "\u048a": "\u0418\u0326\u0306",
    "\u048b": "\u1d0e\u0326\u0306", "Һ": "h", "ӏ": "l", "Ԛ": "Q", "Յ": "3", "՛": "'", "ՠ": "rn", "\u0572": "n\u0329", "յ": "j",
    "ւ": "i", "ֆ": "$", "և": "եi", "\u05b0": "\u05c8", "\u05bc": "\u05c9",
    "\u0629": "o\u0308", "\u0640": "_", "\u0651": "\U00010d27", "\u0670": "\u0e48", "\u068f": "\u062f\u06db", "\u06c4": "\u06c5",
    "\u092f": "\U000119c7", "\u093b": "\U000119d1\u093a", "\u093e": "\U000119d1", "\u093f": "\u09bf", "\u0945": "\u0306",
    "\u0947": "\U00011b64", "\u0949": "\U000119d1\u0306", "\u0956": "\U00011b62", "\u0957": "\U00011b62\U00011b62", "\u0964": "l",
    "\u0970": "°", "\u0972": "\u0905\u0306", "\u0973": "\u0905\u093a", "\u0974": "\u0905\U000119d1\u093a", "\u0975": "\u0905\u094f",
    "\u097b": "\u0917\u0331", "\u097c": "\u091c\u0331", "\u097e": "\u0921\u0331", "\u097f": "\u092c\u0331", "\u110b": "o",
    "⺁": "厂", "⺆": "冂", "⺇": "𠘨", "⺊": "卜", "⺑": "𡯂", "⺕": "彐", "⺝": "月", "⺥": "爫", "⺩": "王", "⺪": "𤴔", "⺬": "示", "⺮": "𥫗",
    "⺰": "纟", "⺳": "㓁", "⺴": "冗", "⺵": "𦉫", "⺶": "羊", "⺷": "𦍌", "⺸": "𦍋", "⺻": "聿", "⺽": "𦥑", "⻆": "角", "⻇": "𧢲",
    "⻊": "𧾷", "⻎": "辶", "⻕": "𨸏", "⻞": "𩙿", "⻡": "𩠐", "⻣": "骨", "⻦": "鸟", "⻧": "卤", "⻪": "黾", "⻱": "龜",
    "丂": "ㄎ", "丅": "T", "丕": "\u110c\u1169", "丛": "\u1109\u1109ー", "丩": "ㄐ", "丫": "Y", "乄": "メ", "于": "\U0001b122", "井": "\U0001b128",
    "今": "\u1109ー\u1100", "仪": "\U0002ebf7", "兑": "兌", "兒": "\U00016ff3", "凐": "湮", "曰": "日", "正": "\U0001d376", "爿": "\u1102\u116e丨",
    "長": "\u1110ー\u1102\u110c",
}
#: Stretches of characters outside Han that are no longer allowed in identifiers (those in a stretch that never were stay so).
RESTRICTED = """
0114-0115 012C-012D 0138 014E-014F 0156-0157 0162-0163 01D5-01DC 01DE-01E3 01EA-01ED 01F0-01F5 01FA-0217 021E-0233 02EC
030F-0314 0324-0325 032D-0330 0335-037D 03FC-0400 040D 0450 045D 048A-048F 049C-049D 04A6-04A7 04B8-04B9 04C1-04CE 04DA-04DB
04EA-04ED 04F6-04F7 04FA-0523 0526-052F 0559 05B4 05EF-05F2 063B-063C 063E-063F 0653 0671 0690 069B-069E 06A3 06AC 06B2 06B4
06B8-06B9 06BF 06E5-06E6 06FA-06FC 0750 0753-0755 0757-075F 0761 0764-0765 0769 076B-076D 0772-077F 0870-088E 08A1 08AA-08BA
08C3-08C6 08C8-08C9 0904 090C 0929 0934 093D 0944 0950 0960-0963 0971 0979-097A 097D 098C 09BD 09D7-09E3 09FE-0A01 0A03
0A66-0A6F 0A72-0A81 0ABD 0AD0-0AE3 0AFA-0AFF 0B0C 0B35 0B3D 0B55 0B57 0B60-0B6F 0B82 0BD0-0C01 0C04 0C0C 0C31 0C3C-0C3D
0C55-0C80 0C8C 0CB1 0CBC-0CBD 0CC4 0CD5-0CE3 0CF1-0D00 0D0C 0D29 0D3A-0D3D 0D4C 0D4E-0D56 0D60-0D6F 0D8E 0D9E 0E4E 0E86 0E89
0E8C 0E8E-0E93 0E98 0EA0 0EA8-0EA9 0EAC 0EAF 0EBA 0ECE 0EDE-0F00 0F35-0F3F 0F6A-0F6C 0F82-0F83 0F86-0F8F 0FAE-0FB0 0FC6
1050-1059 1065-1074 108B-108E 1090-109D 10F7-10FF 1207 1287 12AF 12F8-12FF 130F 131F 1347 135A-138F 179D-179E 17A9 17D7-17DC
1E00-1E0B 1E0E-1E11 1E14-1E1F 1E22-1E23 1E26-1E35 1E38-1E3B 1E40-1E41 1E4C-1E59 1E5C-1E61 1E64-1E6B 1E6E-1E6F 1E72-1E8B
1E8E-1E91 1E94-1E99 1F00-1F9F 1FB0-1FB1 1FB6-1FEA 1FF2-1FFC 2D27-2DDE 3099-309A 3105-31BF A67F-A788 A792-A793 A7C0-AA7A
AA7C-AB67 1133B 16FF0-1E08F
"""
#: Characters outside Han that are allowed in identifiers since.
ALLOWED = "ƁƆƉƊƎƐƑƒƔƖƗƘƙƝƲƳƴƷǝɄɌɍɓɔɖɗɛɣɨɩɲʉʋʒڎ࢏ඦ𑬊"
#: Ideographs outside U+4E00..U+9FA5 that are allowed in identifiers.
HAN = (
    "㑇㑳㓤㕷㖞㖡㖭㖿㗎㗳㗾㘎㘚㤘㥠㥮㧏㧐㧛㧟㧸㧾㨘㩒㩜㩧㩳㬹㭎㮣㱮㳠㷧㷫㹴㻐䁖䁥䁪䂻䃟䄷䅟䌷䎬䎱䏓䏝䑃䓖䓪䘆䙌䙡䜣䜩䝼䞍䟴䢂"
    "䥇䥺䥽䦂䦃䦅䦆䦛䦟䦶䦷䨒䪸䱷䱽䲁䲅䲝䲞䲟䲠䲡䲢䲣䴓䴔䴕䴖䴗䴘䴙䶮𠜎𠜱𠝹𠱓𠱸𠲖𠳏𠳕𠴕𠵼𠵿𠸎𠸏𠹷𠺝𠺢𠻗𠻹𠻺𠼭𠼮𠽌𠾴𠾼𠿪𡁜𡁯𡁵"
    "𡁶𡁻𡃁𡃉𡇙𢃇𢞵𢫕𢭃𢯊𢱑𢱕𢳂𢴈𢵌𢵧𢺳𣲷𤓓𤶸𤷪𥄫𦉘𦟌𦧲𦧺𧨾𨅝𨈇𨋢𨳊𨳍𨳒𩶘"
)
#: Emoji that are shown as such by default and have a text style too, beside those in the Basic Multilingual Plane.
EMOJI_OF_TWO_STYLES = (
    "🀄🈚🈯🌍🌎🌏🌕🌜🍸🎓🎧🎬🎭🎮🏂🏄🏆🏊🏠🏭🐈🐕🐟🐦👂👆👇👈👉👍👎👓👪👽💣💰💳💻💿📋📚📟📤📥📦📪📫📬📭📷📹📺📻🔈🔍🔒🔓🕐🕑🕒"
    "🕓🕔🕕🕖🕗🕘🕙🕚🕛🕜🕝🕞🕟🕠🕡🕢🕣🕤🕥🕦🕧😐🚇🚍🚑🚔🚘🚭🚲🚹🚺🚼"
)
#: Standardized variants that no rule gives, by selector; and the selectors that rotate hieroglyphs.
VARIANTS = {
    "\ufe00": (
        "0ကဂငတထပမယလဝဢေၵၸၺႀ‘’“”ℋℐℒℛℬℰℱℳ∅∩∪∽≂≃≈≨≩≲≳⊊⊋⊓⊔⊕⊗⊜⋍⋚⋛⋜⋝⦷⨼⨽⩬⪝⪞⪬⪭"
        "⫋⫌、。㇀㇆㇉㇏㇐㇑㇒㇔㇕㇗㇛㇜㇝㇥ꡖꡜꡞꡟꡠꡨꩠꩡꩢꩣꩤꩥꩦꩫꩬꩯꩺ！，．０：；？𐫅𐫆𐫖𐫗𐫡𝒜𝒞𝒟𝒢𝒥𝒦𝒩𝒪𝒫𝒬𝒮𝒯𝒰"
        "𝒱𝒲𝒳𝒴𝒵𝬐"
    ),
    "\ufe01": (
        "‘’“”ℋℐℒℛℬℰℱℳ、。㇆㇏㇝！，．：；？𝒜𝒞𝒟𝒢𝒥𝒦𝒩𝒪𝒫𝒬𝒮𝒯𝒰𝒱𝒲𝒳𝒴𝒵"
    ),
    "\ufe02": (
        "‘’“”𝓏"
    ),
}
EGYPTIAN_SELECTORS = "\ufe00-\ufe06"
