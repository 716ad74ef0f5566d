"""Terms that mark parts of addresses, names and letters."""

from __future__ import annotations

#: Terms in lower case, split by bars.
ROAD = """
street|st|road|rd|avenue|ave|lane|ln|drive|dr|way|close|crescent|place|pl|square|sq|boulevard|blvd|court|ct|terrace|highway|hwy|row|gardens|
grove|hill|park|walk|mews|parade|circle|cir|trail|parkway|pkwy|straße|strasse|str|weg|platz|allee|gasse|ring|damm|ufer|chaussee|steig|straat|laan|
plein|gracht|kade|dijk|singel|steeg|dreef|ქუჩა|ქ|გამზირი|გამზ|ჩიხი|მოედანი|შესახვევი|გზატკეცილი|通り|通|丁目|番地|番|号|町|筋
"""
UNIT = """
flat|apt|apartment|suite|ste|unit|floor|fl|room|rm|level|lvl|office|wohnung|whg|stock|og|eg|etage|zimmer|verdieping|appartement|bus|ბინა|სართული|
კორპუსი|კორპ|号室|階|室|棟
"""
REGION = """
county|state|province|region|prefecture|territory|district|borough|bundesland|kreis|landkreis|kanton|bezirk|provincie|gemeente|მხარე|რაიონი|
მუნიციპალიტეტი|県|府|道|都|市|区|郡|村
"""
COUNTRY = """
united states|usa|us|u.s.|u.s.a.|america|canada|united kingdom|uk|u.k.|great britain|britain|england|scotland|wales|northern ireland|germany|deutschland|
de|austria|österreich|switzerland|schweiz|netherlands|nederland|the netherlands|holland|nl|belgium|belgië|belgique|georgia|საქართველო|sakartvelo|ge|
japan|日本|日本国|nippon|nihon|jp|ireland|éire|france|italy|spain|poland|turkey|türkiye|armenia|azerbaijan|russia
"""
LEGAL_FORM = """
ltd|ltd.|limited|llc|l.l.c.|inc|inc.|incorporated|corp|corp.|corporation|plc|llp|lp|co|co.|company|group|holdings|partners|trust|foundation|gmbh|
mbh|ag|kg|ohg|ug|e.v.|ev|gbr|se|kgaa|eg|bv|b.v.|nv|n.v.|vof|v.o.f.|cv|stichting|შპს|სს|ააიპ|სპს|კს|იმ|株式会社|有限会社|合同会社|合資会社|合名会社|一般社団法人|(株)|
(有)|㈱|㈲
"""
HONORIFIC = """
mr|mr.|mrs|mrs.|ms|ms.|miss|mx|dr|dr.|prof|prof.|sir|dame|rev|rev.|herr|frau|hr.|fr.|dipl.-ing.|dhr|dhr.|mevr|mevr.|mw|mw.|de heer|mevrouw|
ბატონი|ქალბატონი|ბატონო|ქალბატონო|ბ-ნი|ქ-ნი|様|さん|氏|殿|先生
"""
SALUTATION = """
dear|hi|hello|hey|greetings|hallo|sehr geehrte|sehr geehrter|liebe|lieber|guten tag|beste|geachte|hoi|goedendag|გამარჯობა|მოგესალმებით|ძვირფასო|
პატივცემულო|拝啓|前略|お世話になっております
"""
CLOSING = """
regards|kind regards|best regards|warm regards|best|sincerely|yours sincerely|yours faithfully|cheers|thanks|thank you|many thanks|best wishes|cordially|
mit freundlichen grüßen|freundliche grüße|viele grüße|beste grüße|mfg|liebe grüße|herzliche grüße|met vriendelijke groet|met vriendelijke groeten|groeten|
hartelijke groeten|mvg|პატივისცემით|საუკეთესო სურვილებით|მადლობა|敬具|よろしくお願いします|よろしくお願いいたします|以上
"""


def terms(text: str) -> list[str]:
    return [t.strip() for t in text.replace("\n", "").split("|") if t.strip()]


DICTIONARIES = {name: terms(text) for name, text in (
    ("road", ROAD),
    ("unit", UNIT),
    ("region", REGION),
    ("country", COUNTRY),
    ("legal_form", LEGAL_FORM),
    ("honorific", HONORIFIC),
    ("salutation", SALUTATION),
    ("closing", CLOSING),
)}
