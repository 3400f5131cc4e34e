"""Ways in which sources write the entries of the reference list (fixed values)."""

STATUS = {
    "ACTIVE": "active, act, actv, is active, currently active, coverage active, active paid, active/enrolled, enrolled, effectuated, in force, inforce, activo, activa, vigente, in good standing",
    "PENDING": "pending, pend, pndg, pending cms, pending review, in process, submitted, app submitted, application submitted, under review, awaiting carrier, not yet effective, pendiente, en proceso",
    "TERMINATED": "terminated, term, termed, term'd, trmntd, termination, terminated moved, terminado, terminada, lapsed, lapse, lapse nonpay, coverage ended, expired, disenrolled, vencido",
    "CANCELLED": "cancelled, canceled, cancel, cancld, cxl, cx'd, called off, cancelled before eff, withdrawn, withdrew application, app withdrawn, cancelado, cancelada, retirado",
    "UNKNOWN": "unknown, unk, unkn, unknwn, status unknown, not known, unknown per carrier, desconocido, desconocida, no se sabe",
}
LINE_OF_BUSINESS = {
    "MA": "ma, mapd, ma only, medicare advantage, medicare advantage w/ rx, medicare advantge w/ rx, med adv, med advantage, medicare adv, medicare adv hmo, medicare adv ppo, adv hmo pos, advantage plan, part c, medicare part c",
    "PDP": "pdp, prescription drug plan, pres drug plan, prescription drugs, drug plan, rx plan, standalone pdp, stand alone drug, part d, part d rx, med d, medicare part d",
    "MEDSUPP": "medsupp, medicare supplement, medicare supplemental, medicare supp, med supp, med sup, supp, supplement, medigap, medigap plan g, medigap plan n, medi gap n, medi gap g, medsup, medsup plan g, medsup plan n, medsupp plan n, medsupp plan g",
    "ACA": "aca, affordable care act, aca individual, individual marketplace, individual & family, indiv/family mktplace, ifp aca, ifp, marketplace, marketplace plan, health ins marketplace, exchange plan, on exchange, off exchange, obamacare",
}
#: Old postal and newspaper abbreviations, Spanish names and nicknames; names and codes come from the list itself.
STATE = {
    "AL": "ala", "AK": "alsk, alas", "AZ": "ariz", "AR": "ark", "CA": "cal, cali, calif", "CO": "colo", "CT": "conn",
    "DE": "del, dela", "DC": "washington dc, wash dc, dist of columbia, distrito de columbia", "FL": "fla, flor, flda",
    "GA": "geo", "HI": "hawai'i, hawaii state", "ID": "ida", "IL": "ill, ills", "IN": "ind", "IA": "ioa", "KS": "kan, kans",
    "KY": "ken, kent, ky state", "LA": "luisiana, lou", "ME": "me state", "MD": "mary", "MA": "mass", "MI": "mich",
    "MN": "minn", "MS": "miss, misisipi", "MO": "misuri", "MT": "mont", "NE": "neb, nebr", "NV": "nev", "NH": "nueva hampshire, nuevo hampshire",
    "NJ": "nueva jersey", "NM": "n mex, new mex, nuevo mexico", "NY": "nys, nueva york", "NC": "carolina del norte", "ND": "dakota del norte",
    "OH": "o h", "OK": "okla", "OR": "ore, oreg", "PA": "penn, penna, pensilvania", "RI": "r island", "SC": "carolina del sur",
    "SD": "dakota del sur", "TN": "tenn", "TX": "tex, tejas", "UT": "ut", "VT": "verm", "VA": "virg", "WA": "wash, wash state, washington state",
    "WV": "w va, west va, virginia occidental", "WI": "wis, wisc", "WY": "wyo",
}
ALIASES = {"status": STATUS, "line_of_business": LINE_OF_BUSINESS, "state": STATE}
#: How the first word of a state's name is shortened.
COMPASS = {"north": ("n", "no"), "south": ("s", "so"), "west": ("w",), "new": ("n",), "rhode": ("r",)}
#: Last words that are shortened after a compass word.
TAILS = {"dakota": ("dak", "dakota"), "carolina": ("car", "carolina")}
