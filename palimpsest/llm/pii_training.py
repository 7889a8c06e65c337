"""Training of the personal-data field on generated sentences.

No table holds marked personal data, so sentences with known segments are generated from the grammar below, which is
written after public forms, letters, log lines and messages (none of it comes from a table the engine is run on). Words
around a segment are replaced by invented ones at random, so that the field learns to judge a span by itself too. The
conditional likelihood of the right segmentation among all sets of spans of the lattice is maximized by stochastic
gradient ascent, with expectations from the forward-backward recursion over segments.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

from palimpsest.llm.lexicon import GIVEN_NAMES, HAN_SURNAMES, RUSSIAN_GIVEN, TECHNICAL
from palimpsest.llm.pii import STREET_AFTER, Segment, Span, Tokens, features, lattice, tokens

_ONSETS = "b c d f g h j k l m n p r s t v w z br cl dr fl gr kr pl pr sk sl sp st th tr zw".split()
_NUCLEI = "a e i o u ai ea ei io oa ou é ö ü ã".split()
_CODAS = "n r s t l m k x nd rk st ld rn sk lm".split()


def _invented(r: random.Random) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_NUCLEI) for _ in range(r.choice((1, 2, 2, 3)))).capitalize() + r.choice(_CODAS)


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randrange(10)) if c == "0" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in shape)


# Family names of several languages, and characters of Chinese given names.
_FAMILIES = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Thompson White Harris Clark Lewis Walker Hall Young Wright Green Baker Campbell Mitchell Carter "
    "Turner Phillips Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Morgan Cooper Reed Bailey Bell Kelly Howard Ward Watson Brooks Gray James Bennett Wood Barnes Ross "
    "Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Moreau Laurent Lefèvre García Fernández González Rodríguez López Martínez Sánchez Pérez Rossi Russo Ferrari Silva "
    "Santos Oliveira Nguyen Tran Kim Park Lee Tanaka Suzuki Sato Kowalski Nowak Novák Horvat Ivanov Petrov Andersson Hansen Nielsen Okafor Adeyemi Singh Patel Kumar Sharma Khan Ahmed"
).split()
_RUSSIAN_FAMILIES = "Иванов Петров Сидоров Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков Павлов Фёдоров Орлов Никитин Захаров Зайцев Ильин Калинин".split()
_HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华玉兰红建国文志宇浩然子轩欣怡梓涵雪梅晨曦"
_PARTICLES = ("de la", "van der", "van", "von", "de", "del", "dos", "di", "bin", "al")
# Shapes of phone numbers (0 a digit) and of identity, social and passport numbers (A a capital) in public forms.
_PHONES = (
    "+0 000 000 0000|+0-000-000-0000|+0 (000) 000-0000|(000) 000-0000|000-000-0000|000.000.0000|+00 0000 000000|+00 00 00000000|+00 0 00 00 00 00|00 00 00 00 00|000 00000 000|00000 000000|"
    "+000000000000|+00 000 0000000|000 0000 0000|0000 000000|(0000) 000000|000-0000|0000000|00000000000|+00 000 0000 0000|+00-000-0000000|+000 00 000 0000|00-0000-0000|+00 (0) 00 0000 0000"
).split("|")
_IDS = "000-00-0000|000 00 0000|AA000000A|AA 00 00 00 A|A0000000|A00000000|AA000000|00.000.000-0|00.000.000-A|0.000.000-0|AA0000000|00000000A|000000000|000000000000000000|00 000000 A 000".split("|")
_DOMAINS = "example.com example.org example.net mail.example.com team.test inbox.invalid post-box.example office.test news.example.org company.com uni.edu web.de provider.co.uk acme.com correo.es firma.ru".split()
_NOUNS = "box report door lamp table engine folder camera bottle garden desk server cable bicycle kettle poster window printer ladder notebook cabinet receipt heater carpet fence guitar roof piano sofa blanket barrel".split()
_ADJECTIVES = "old small bright heavy quiet plain rusty open warm brief loose calm sharp green hollow narrow sturdy yellow gentle".split()
_VERBS = "checked signed moved opened closed stored booked fixed sent flagged copied kept renewed painted weighed borrowed returned praised examined".split()
_MONTHS = "January February March April May June July August September October November December".split()
_PLACES = "Mills Point Ridge Harbour Cross Fen Bay Valley Park Hub Bridge Station".split()
_PRODUCTS = "Gateway Console Planner Indexer Server Toolkit Suite Cloud Engine Studio".split()
_ORGS = "Systems Robotics Foods Holdings Research Studios Works Partners Logistics Analytics Publishing Instruments Bank Group".split()
_TECHNICAL = sorted(TECHNICAL)


def _given(r: random.Random) -> str:
    full = r.choice(list(GIVEN_NAMES))
    form = r.choice([full, full, full, *GIVEN_NAMES[full].split()]).capitalize()
    return _invented(r) if r.random() < 0.08 else form


def _family(r: random.Random) -> str:
    f = r.choice(_FAMILIES) if r.random() < 0.35 else _invented(r)
    u = r.random()
    if u < 0.06:
        return f"{f}-{r.choice(_FAMILIES)}"
    return f"{r.choice(_PARTICLES)} {f}" if u < 0.13 else f"O'{f}" if u < 0.15 else f


def _russian(r: random.Random) -> str:
    g, f = r.choice(sorted(RUSSIAN_GIVEN)).capitalize(), r.choice(_RUSSIAN_FAMILIES)
    if g[-1] in "ая":
        f += "а"
    elif r.random() < 0.4 and g[-1] not in "ьйая":
        g, f = g + r.choice("уа"), f + r.choice("уа")
    return f"{g} {f}" if r.random() < 0.7 else f"{f} {g}"


def _chinese(r: random.Random) -> str:
    return r.choice(sorted(HAN_SURNAMES)) + "".join(r.choice(_HAN_GIVEN) for _ in range(r.choice((1, 2, 2))))


def _name(r: random.Random) -> str:
    g, f = _given(r), _family(r)
    if r.random() < 0.05:
        g = f"{g}-{_given(r)}"
    first = g if r.random() < 0.74 else g[0] + r.choice((".", ".", ""))
    middle = f" {r.choice('ABCDEFGHJKLMNPRST')}." if len(first) > 2 and r.random() < 0.15 else f" {_given(r)}" if len(first) > 2 and r.random() < 0.04 else ""
    u = r.random()
    if u < 0.7:
        return f"{first}{middle} {f}"
    if u < 0.93 or len(first) < 3:
        return f"{f}, {first}{middle}" if len(first) > 1 else f"{f}, {first}."
    return f"{f} {first}"


def _email(r: random.Random) -> str:
    g, f = _given(r).lower(), re.sub("[^a-z]", "", _family(r).lower()) or "box"
    user = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{r.randrange(100)}", f"{g}+{r.choice(_NOUNS)}", f"{f}-{g}", f"{f}"]).encode("ascii", "ignore").decode() or "box"
    domain = r.choice(_DOMAINS)
    if r.random() < 0.25:
        domain = f"{r.choice(_NOUNS)}-{domain}"
    u = r.random()
    if u < 0.7:
        return f"{user}@{domain}" if u < 0.66 else f"{user}@{domain}".upper()
    at, dot = r.choice(((" (at) ", " dot "), (" [at] ", " dot "), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", ".")))
    return (user.replace(".", dot) if r.random() < 0.5 else user) + at + domain.replace(".", dot)


def _address(r: random.Random) -> str:
    n, x, u = r.randrange(1, 400), _invented(r), r.random()
    unit = f"{r.choice(('Flat', 'Apt', 'Unit', 'Suite', 'Apartment'))} {r.randrange(1, 60)}"
    if u < 0.25:
        a = f"{n} {x} {r.choice(STREET_AFTER)}"
    elif u < 0.4:
        a = f"{n}{r.choice('ABC')} {r.choice(('Old', 'New', 'Upper', 'North', 'Saint'))} {x} {r.choice(STREET_AFTER)}"
    elif u < 0.5:
        a = f"{n}, rue de {x}"
    elif u < 0.6:
        a = f"{n} {r.choice(('rue', 'avenue', 'boulevard', 'quai'))} {r.choice(('', '', 'de la ', 'du '))}{x}"
    elif u < 0.7:
        return f"Calle {r.choice(('', '', 'de ', 'del '))}{x}{r.choice(('', ','))} {n}"
    elif u < 0.76:
        return f"{r.choice(('Avenida', 'Via', 'Plaza', 'Paseo', 'Viale', 'Rua'))} {x} {n}"
    elif u < 0.78:
        return f"{r.choice(('улица', 'ул.', 'проспект'))} {r.choice(_RUSSIAN_FAMILIES)}а, {n}"
    else:
        return f"{x}{r.choice(('straße', 'weg', 'gasse', 'platz', 'allee'))} {n}{r.choice(('', '', 'a', 'b'))}"
    v = r.random()
    return f"{unit}, {a}" if v < 0.2 else f"{a}, {unit}" if v < 0.45 else a


# Fixed grammar: {NAME} and the like stand for generated segments, other marks for words.
_CARRIERS = """
Applicant: {NAME}|Full name: {NAME}|Name of holder: {NAME}, document no. {ID}|Account holder {NAME}, tax id {ID}|Signed, {NAME}|Kind regards,\n{NAME}|Dear {NAME},|From: {NAME} <{EMAIL}>|To: {NAME}; Cc: {NAME}|Spoke with {NAME} about the {adj} {noun}.|{NAME} {verb} our {noun} last week.|According to {NAME}, the {noun} is {adj}.|Thanks to {NAME} the {noun} got {verb}.|This {noun} is {NAME}'s.|{NAME}'s {noun} looks {adj}.|Did {NAME} call back?|Is {NAME} coming?|Interview with {NAME} on {month} {small}.|Dr. {NAME} {verb} me.|Prof. {NAME} and Mrs {NAME} agreed.|My doctor is {NAME}.|My landlord, {NAME}, {verb} the {noun}.|I owe {NAME} a {noun}.|she introduced {NAME} to {NAME}|{NAME} is allergic to nuts.|{NAME} works at {word} {org}.|{NAME} studies in {word}.|{NAME} likes {word}.|{NAME} is away until {month}.|{NAME}: see you at {time}.|The witness {NAME} stayed calm.|author={NAME};|assignee: {NAME}, due {month} {small}|Beneficiary {NAME} was informed.|owner {NAME}, plate {code}|Kept by {NAME}.|{noun} for {NAME}|{NAME} {w} {w} {w}|{w} {w} {NAME} {w}|{w} {NAME}.|{NAME} and {NAME}|{NAME}, {word} {org}|We hired {NAME} from {word} {org}.|{W} {NAME} {w}.|{W} {NAME} at {EMAIL} {w}.|{Verb} {NAME} {w} {w}.|{Noun} {NAME} {w}|{NAME} or {ADDRESS}
Mail: {EMAIL}|E-mail address {EMAIL}|You can write me under {EMAIL}, thanks.|mail me at {EMAIL}|<{EMAIL}>|email={EMAIL}|Invoices go to {EMAIL} only.|Cc {EMAIL} and {EMAIL}, please.|Login {EMAIL} was locked.|Newsletter for {EMAIL} ended.|Bounce: {EMAIL} unknown.|{w} {EMAIL} {w}|my address is {EMAIL}|Answer to {EMAIL}.|{NAME} ({EMAIL}) {verb} it.|{EMAIL}
Tel. {PHONE}|Phone: {PHONE}|Fax {PHONE}|Cell {PHONE}|call {PHONE}|Dial {PHONE} before {time}.|Our hotline is {PHONE}.|WhatsApp {PHONE}, evenings|Reachable under {PHONE} until {time}.|{NAME}, {PHONE}|{NAME} ({PHONE})|{NAME}: {PHONE}|tel:{PHONE}|mobile={PHONE}|number is {PHONE}|You can reach me on {PHONE} any day.|Please contact {NAME} at {PHONE}.|missed call from {PHONE}|text {PHONE} or mail {EMAIL}|{w} {PHONE} {w}|phone {PHONE}; email {EMAIL}|If it gets lost, ring {PHONE}.
Identity card no. {ID}|Passport no. {ID}|National insurance number {ID}|Social security number: {ID}|SSN {ID}|DNI {ID}|NIE {ID}|Her passport is {ID}, valid until {month}.|Holder of passport {ID}|id: {ID}|id number {ID}; phone {PHONE}|identity {ID}, mobile {PHONE}, mail {EMAIL}|Citizen with identity number {ID} applied.|{NAME} showed identity document {ID}.|{NAME}, passport {ID}|{NAME} (SSN {ID})|{NAME}: {ID}|on record: {ID}|Proof of identity: {ID}|ssn={ID}|Tax number of {NAME} is {ID}.|Please verify social security no. {ID} today.|ID {ID} {w}|resident permit {ID} of {NAME}|{ADDRESS} and passport {ID}|passport {ID} and {ADDRESS}|{w} {w} {ADDRESS} and {ID}.|{w} {w} {ID} and {ADDRESS}.|{w} {ID} {w}|{ID}, {PHONE}
Home address: {ADDRESS}|Address {ADDRESS}, {word}|{ADDRESS}, {word} {place}|We live in {ADDRESS}.|Our office is in {ADDRESS}, second floor.|Pick it up in {ADDRESS} after {time}.|Deliver the {noun} to {ADDRESS}.|He left {ADDRESS} in {month}.|{NAME} rents {ADDRESS}.|{NAME}, {ADDRESS}, {word}|Meet me outside {ADDRESS}!|ship_to={ADDRESS};|addr: {ADDRESS}|The house in {ADDRESS} has a {adj} {noun}.|{w} {w} {ADDRESS} {w}|Postal: {ADDRESS}. Phone: {PHONE}.|born in {word}, lives in {ADDRESS}|{word} relocated to {ADDRESS}.
联系人：{HAN}，手机{PHONE}。|收件人{HAN}|我叫{HAN}。|{HAN}先生您好|{HAN}女士已付款|经理{HAN}批准了|通知{HAN}明天开会。|Ask {HAN} for the {noun}.|Please contact {HAN} at {PHONE}.|{HAN} {verb} the {noun}.|{HAN}, {word} {org}|电子邮件：{EMAIL}|电话：{PHONE}|身份证号码：{ID}|护照{ID}|住址：{HANADDR}|我住在{HANADDR}。|快递送到{HANADDR}，电话{PHONE}。|昨天遇到{NAME}。|致电{NAME}（{PHONE}）|地址是{ADDRESS}。|把包裹送到{ADDRESS}，谢谢。|{NAME}的号码是{PHONE}|请拨{PHONE}。
高兴认识你们。|方法很简单，时间也够。|周末我们去{word}看花。|马上就到，常常这样。|江边的石头很多。|金色的叶子，白色的雪。|我们喜欢在{word}喝咖啡。|他们整理了文件和密码。|任务完成，万一失败再说。|请把{noun}放好。|程序在{word}运行正常。|明天开会讨论计划，张贴通知。|史料和贾商|汤很好喝，黄瓜也新鲜。|毛巾在房间里。|文件已保存。|白天很热，林间很凉。|于是我们回家。|陈旧的机器需要修理。|我想学习钢琴，不想跑步。|新房子比旧房子大。|温度高于三十度。|向前走一百米。
Позвоните {RUS} по номеру {PHONE}.|Меня зовут {RUS}.|Письмо для {RUS}.|{RUS} живёт в Москве.|Передайте {RUS} привет.|Адрес: {ADDRESS}.|Спасибо, {RUS}!|{RUS} ({PHONE})|Я забыл {lower} дома.|Вчера шёл дождь. Сегодня тепло.|Москва и Париж большие города.|Красная площадь открыта.|Россия играет завтра.|Новый Год близко.
{tech} {long} was {verb}|{tech} id {trace} ended|{tech} number {long}|{Tech} {long}: {verb}|The {tech} {trace} took {small} ms.|{tech} {code} has {small} items|{tech}={long}|ratio {small}:{small}, size {small}x{small}|Release {version} replaced {version}.|v{version} is stable|firmware {version}.{small} on {word}|total {small} of {long} bytes|IP 10.{oct}.{oct}.{oct} is down|Port {small} on {word} is closed.|{small} {noun}s and {small} {noun}s|Row {long} of {long}|ISBN {isbn} is out of print|account {code}, amount {small}.{oct} EUR|{word} {version} needs {small} MB|{word} {word} {small} {version}.|{word} {small} {version} {w}|{Tech} {long} {w} the {noun}.|{Tech} {trace} {w} {w}.|{Tech} id {trace} {w} {tech} {version}.|{w} {w} {tech} {long} {w}|range {small}-{small}, offset {trace}|on {date} at {time}|since {date} {time} UTC|score {small}/{small}, {small} points|Flight {flight} leaves at {time}.|room {small}, seat {oct}A|@{noun}_{noun} liked it|handle {noun}@{noun} in the shell|user@{noun}|lat {oct}.{long}, lon {oct}.{long}
{word} {org} Ltd {verb} the {noun}.|{word} {org} opened a site in {word}.|{word} {product} {small} replaces {word} {product}.|The {word} {place} ferry was late.|We crossed {word} {place} and {word} {place}.|{word}, {word} and {word} took part.|{word}, {word}|Between {word} and {word} lies a {noun}.|Tickets to {word}, {word} or {word} {place} sold out.|{word} {word} is a band.|The {word} {word} {noun} won.|On {month} {small} the {noun} closes.|In {month} {word} {verb} the {noun}.|Dear Sir or Madam,|Dear Customer, Good Morning.|Happy New Year!|Yes, I {verb} it.|No, A {noun} will do.|OK, Great.|Also, The {noun} is {adj}.|By the way, I {verb} {word}.|I like {word} more than {word}.|{word} is the capital.|{word} {verb} the {noun} for {word}.|Mr {word} {verb} the {noun}.|Mrs {word} of {word} {org} {verb} it.|{word} ({small})|{word}, {small} {noun}s|{word} {small}|Chapter {small}, Section {small}|Figure {small} shows {word}.|Room {small} is free.|Floor {small}, {word} {place}|No {small} is missing.|{small} {word} {noun}s|{small} {month}|{month} {small}, {word}|Unit {small} failed.|Square {small}|Road {small} is closed.|{Noun} {word} {verb} {small} {noun}s at {time}.|{W} {word} {w} {w}.|{W} {w} {word} {w}.|prefers {WORD} {WORD}, {w}|{NAME} likes {WORD} {WORD}, {w} {w}.|the road to {word} {small} km|{word} Street is long.|{word} Square and {word} Park|{w} {word} {w} {w}|{w} {w} {word} {word} {w}|{word} {w} {word}, {w}|{Given} {verb} the {noun}.|{Given}, the {noun} is {adj}.|Thanks, {Given}!|{Given} and {Given} {verb} it.|{Given} from {word} {org}|Ask {Given} or {word}.|{Given} {org} Ltd|{Given} {product} {small}|Saint {Given} Square|{word}'s {noun} near {word} {place}|The {word} team, {word} desk and {word} support|To {word} with {word}|Emergency: none|Status: Open|{word} {Noun} {w}|New {Noun}, Old {Noun}|{Noun} {Noun} {small}|I think so. {word} agrees.|The {noun} of {word} {code} is {adj}.|About {small} of {small} {noun}s {verb} by {word} in {month}.
"""


def generate(count: int, seed: int) -> list[tuple[str, list[Segment]]]:
    """Texts of one to three sentences, each with its true segments."""
    r = random.Random(seed)
    lines = [[x for x in line.split("|") if x] for line in _CARRIERS.replace("\n{NAME}|", "~{NAME}|").strip().splitlines()]
    weight = [4, 2, 2, 3, 2, 1.2, 0.8, 0.8, 2.2, 6]
    make = {
        "NAME": _name, "EMAIL": _email, "PHONE": lambda q: _digits(q, q.choice(_PHONES)), "ID": lambda q: _digits(q, q.choice(_IDS)), "ADDRESS": _address, "HAN": _chinese, "RUS": _russian,
        "HANADDR": lambda q: f"{q.choice('建中长朝海南新')}{q.choice('国山安阳淀京华')}{q.choice(('路', '街', '大道', '巷'))}{q.randrange(1, 300)}号{q.choice(('', '', f'{q.randrange(1, 40)}室'))}",
    }
    types = {"HAN": "NAME", "RUS": "NAME", "HANADDR": "ADDRESS"}
    oct_ = lambda: str(r.randrange(1, 256))
    fill = {
        "noun": lambda: r.choice(_NOUNS), "Noun": lambda: r.choice(_NOUNS).capitalize(), "adj": lambda: r.choice(_ADJECTIVES), "verb": lambda: r.choice(_VERBS), "month": lambda: r.choice(_MONTHS),
        "word": lambda: _invented(r), "W": lambda: _invented(r), "WORD": lambda: _invented(r).upper(), "Verb": lambda: r.choice("Phone Meet Visit Invite Email Reach Text Tell Remind Thank Join Follow Ping Contact".split()), "w": lambda: _invented(r).lower(), "place": lambda: r.choice(_PLACES), "org": lambda: r.choice(_ORGS), "product": lambda: r.choice(_PRODUCTS),
        "small": lambda: str(r.randrange(1, 10000)), "time": lambda: f"{r.randrange(24)}:{r.randrange(60):02d}", "version": lambda: f"{r.randrange(9)}.{r.randrange(30)}.{r.randrange(60)}",
        "code": lambda: f"{_digits(r, 'AAA')}-{r.randrange(1000, 99999)}", "long": lambda: _digits(r, "0" * r.randrange(6, 13)), "trace": lambda: "-".join(_digits(r, "0" * r.choice((1, 2, 3, 4))) for _ in range(3)),
        "tech": lambda: r.choice(_TECHNICAL), "Tech": lambda: r.choice(_TECHNICAL).capitalize(), "oct": oct_, "Given": lambda: _given(r), "date": lambda: f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
        "isbn": lambda: _digits(r, "978-0-000-00000-0"), "flight": lambda: _digits(r, "AA0000"), "lower": lambda: "".join(r.choice("абвгдеиклмнопрст") for _ in range(6)),
    }
    out = []
    for _ in range(count):
        text, segs = "", []
        for _ in range(r.choice((1, 1, 2, 3))):
            carrier = r.choice(r.choices(lines, weight)[0]).replace("~", "\n")
            # words of the carrier give way to invented ones, so that unseen surroundings are learned as such
            if r.random() < 0.35:
                carrier = re.sub(r"(?<![{\w])[a-z]{2,}(?![}\w])", lambda m: _invented(r).lower() if r.random() < 0.5 else m.group(), carrier)
            pos, loud = 0, r.random() < 0.06
            if text:
                text += r.choice((" ", " ", " ", "\n", ", ", ". "))
            while pos < len(carrier):
                if carrier[pos] == "{":
                    end = carrier.index("}", pos)
                    key = carrier[pos + 1 : end]
                    if key in make:
                        value = make[key](r)
                        segs.append(Segment(len(text), len(text) + len(value), types.get(key, key)))
                    else:
                        value = fill[key]()
                    text += value.upper() if loud and key not in make else value
                    pos = end + 1
                else:
                    text += carrier[pos].upper() if loud else carrier[pos]
                    pos += 1
        out.append((text, segs))
    return out


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _marginals(segs: list[Segment], scores: list[float]) -> list[float]:
    """Probability of each segment under the field (segments do not overlap)."""
    n = len(segs)
    order = sorted(range(n), key=lambda i: (segs[i].end, segs[i].start))
    ends = [segs[i].end for i in order]
    before = [bisect_right(ends, segs[i].start, 0, k) for k, i in enumerate(order)]
    alpha = [0.0]
    for k, i in enumerate(order):
        alpha.append(_log_add(alpha[k], alpha[before[k]] + scores[i]))
    beta = [-1e30] * n + [0.0]
    for k in range(n - 1, -1, -1):  # beta[k]: all that may follow state k
        beta[k] = _log_add(beta[k], beta[k + 1])
        i = order[k]
        beta[before[k]] = _log_add(beta[before[k]], scores[i] + beta[k + 1])
    out = [0.0] * n
    for k, i in enumerate(order):
        out[i] = math.exp(min(0.0, alpha[before[k]] + scores[i] + beta[k + 1] - alpha[-1]))
    return out


def segment(t: Tokens, s: Span) -> Segment:
    return Segment(t.start[s.first], t.end[s.last - 1], s.kind)


@lru_cache(1)
def trained_weights(count: int = 9000, epochs: int = 3, rate: float = 0.15, seed: int = 11) -> dict[str, float]:
    """Weights of the field; the same on every call, as data and order are seeded."""
    data = []
    for text, truth in generate(count, seed):
        t = tokens(text)
        spans = lattice(t)
        if spans:
            true, segs = set(truth), [segment(t, s) for s in spans]
            data.append(([features(t, s) for s in spans], segs, [1.0 if s in true else 0.0 for s in segs]))
    weights: dict[str, float] = {}
    r = random.Random(seed)
    for epoch in range(epochs):
        r.shuffle(data)
        step = rate / (1 + epoch)
        for feats, segs, truth in data:
            scores = [sum([weights.get(f, 0.0) for f in fs]) for fs in feats]
            for fs, t, p in zip(feats, truth, _marginals(segs, scores)):
                g = step * (t - p)
                if abs(g) > 1e-4:
                    for f in fs:
                        weights[f] = weights.get(f, 0.0) + g
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}
