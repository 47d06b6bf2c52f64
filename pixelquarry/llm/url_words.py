"""Words of the labelled URL table of ``url_filter``, by category.

Origin: written by hand from the categories that public blocklists and directories have (gambling, adult, drugs, loans and
scams, malware and spam, piracy, advertising; and for the good side schools, science, news, trades, places). No host or path
of ``pages`` was looked up for it, but six of its bad hosts were known to the author from a review, so their verdicts don't measure recall.
None of the six stands here or is put together from here: words and ``AFFIXES`` are joined, never two words. Both labels get the same affixes and
shapes, so that only the words tell them apart.

The good words outnumber the bad ones three to one, as ordinary hosts do on the web, so that a host of unknown words is allowed.

``HELD_OUT_*`` are whole hosts that the table doesn't hold: ``HELD_OUT_KNOWN`` joins words of the table anew, ``HELD_OUT_NEW`` uses words that aren't in it.
"""

from __future__ import annotations

BLOCK = {
    "gambling": "casino slots roulette blackjack poker betting bets wager jackpot lottery bingo bookmaker gambling baccarat",
    "adult": "porn xxx sex adult nude escort hentai erotic webcam hookup milf fetish camgirls",
    "drugs": "viagra cialis pills pharmacy steroids weightloss slimming xanax tramadol vicodin nodrx kratom",
    "loans and scams": "payday loans fastcash getrich forex cryptoscam scam phishing prize winner giveaway freegift doubler ponzi replica fakeid",
    "malware and spam": "malware trojan spyware adware ransom botnet keylogger exploit spam bulkmail linkfarm doorway clickbait",
    "piracy": "warez crack keygen torrent cracked serialz nulled pirate leaked freemovies",
    "advertising": "ads adserver popup banner tracker tracking clicks doubleclick affiliate pixeltag",
}
ALLOW = {
    "schools": "university school library college academy student teacher lecture homework kindergarten",
    "science": "physics biology chemistry science astronomy museum history geology climate ocean research laboratory",
    "news": "news journal weather gazette tribune herald radio magazine chronicle",
    "reference": "encyclopedia dictionary handbook manual archive atlas recipes docs wiki tutorial",
    "trades": "bakery garden gardening carpenter plumber furniture bicycle hotel restaurant florist dentist optician",
    "culture": "theatre orchestra painting poetry novel cinema gallery concert folk choir",
    "places": "river meadow island village harbour valley bridge forest mountain county coast orchard",
    "household": "kitchen table window candle blanket carpet lamp mirror basket kettle spoon plate curtain pillow ladder hammer bucket broom drawer chimney",
    "food": "apple bread cheese butter honey tomato potato onion pepper salad coffee tea soup noodle rice lemon cherry pumpkin biscuit vegetable",
    "nature": "tree flower grass animal bird eagle rabbit horse cattle salmon whale dolphin beetle spider butterfly rainbow thunder sunrise winter summer autumn spring desert jungle",
    "work": "engineer builder architect designer lawyer accountant nurse doctor teaching painter printer writer editor translator driver pilot sailor tailor mechanic manager",
    "sport": "football tennis cycling running rowing sailing climbing hiking fishing chess athletics gymnastics skating rugby cricket marathon stadium",
    "machines": "engine computer software network telephone camera battery circuit sensor robot tractor locomotive aircraft satellite keyboard compiler database protocol",
    "arts": "music guitar piano drummer singer dancing sculpture photograph literature fiction drama comedy ceramics weaving knitting embroidery calligraphy",
    "people": "family children parents brother daughter neighbour friends youth senior community society foundation institute association workshop",
    "life": "health medicine therapy nutrition fitness insurance pension housing moving wedding birthday holiday vacation journey passport luggage calendar",
    "trade": "store supply wholesale export textile timber steel paper glass leather jewellery clothing shoes toys stationery hardware",
    "public": "council parliament hospital police transport railway bus charity volunteer church opendata",
}
AFFIXES = ["best", "online", "my", "top", "city", "club", "home", "world", "big", "open", "central", "365"]
SHAPES = [
    "https://www.{0}.test/en/{1}", "http://m.{0}.test/de/{1}.html", "https://blog.{0}.test/fr/{1}?page=2", "http://{0}.test/es/{1}/",
    "https://{0}.test/", "http://{0}.test/index.php?id={1}", "https://shop.{0}.test/item/{1}", "https://{0}.test/a/{1}/page.html",
]

#: (host, label) pairs of words of the table with partners it doesn't know.
HELD_OUT_KNOWN = [(h, 1) for h in "viagra-shop porn-tube lottery-prize lucky-roulette royalpoker torrent-bay megacrack sexchat-live xanax-direct popup-hits crypto-scam".split()]
HELD_OUT_KNOWN += [(h, 0) for h in "science-daily riverhotel northern-library historytoday physics-forum village-bakery museum-guide weatherline forest-school oldtown-theatre".split()]
#: (host, label) pairs without a word of the table.
HELD_OUT_NEW = [(h, 1) for h in "keno-palace sportstake-vip bitcoin-mixer hotgirls-now cheapmeds-rx quickcredit-today rootkit-kit moviez-rip".split()]
HELD_OUT_NEW += [(h, 0) for h in "pottery-studio lakeside-inn mathematics-notes parish-hall swimming-pool farmers-market violin-lessons trainspotter".split()]


def labelled() -> list[tuple[str, float]]:
    """``url`` and label (1 is block): each bad word alone, after an affix and before one, each good word in two of these forms; in shapes taken in turn."""
    rows = []
    for label, groups in ((1.0, BLOCK), (0.0, ALLOW)):
        for i, word in enumerate(w for words in groups.values() for w in words.split()):
            a, b = AFFIXES[i % len(AFFIXES)], AFFIXES[(i + 5) % len(AFFIXES)]
            forms = (word, f"{a}-{word}", f"{word}{b}")
            for j, host in enumerate(forms if label else (forms[i % 3], forms[(i + 1) % 3])):
                rows.append((SHAPES[(i + 3 * j) % len(SHAPES)].format(host, 100 + 7 * i), label))
    return rows
