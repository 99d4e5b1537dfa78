"""Training of the personal-information tagger, in numpy.

Every labelled span is composed here: names, numbers, addresses and mailboxes are generated from the
forms of many countries, none of them taken from the texts that are searched, and set into sentences
of a bounded sample of a corpus that is not searched (``documents``). The weights in the repository
are the mean of two trainings, this one and an earlier one it went on from (``mean``). Sentences as they are, firms,
places and other numbers teach what is no personal information.

    python -m quillmark.llm.pii_training --texts /root/testdata/sf0.1 --minutes 9 --resume
"""

from __future__ import annotations

import argparse
import multiprocessing as mp
import random
import re
import time
import unicodedata

import numpy as np

from quillmark.llm.pii import N_SIGNS, N_TAGS, TYPES, WEIGHTS, encode, load_weights

#: Bound of the sample of carrier texts.
SAMPLE = 40_000
EMBED, HIDDEN, SPAN, GROUP = 20, 40, 112, 96

#: Given names in common use; half of all names are built from syllables instead.
GIVEN = """Aaron Adam Adele Agnes Aisha Alan Albert Alejandro Alexander Alice Amara Amit Ana Anders Andrea Andrei André Angela Anna Anneke Anthony Antonio Arthur Astrid
Barbara Beatriz Ben Benjamin Bill Björn Bob Brian Bruno Camille Carl Carla Carlos Charles Charlotte Chiara Chloé Chris Christine Christopher Claire Clara Dan Daniel David Deborah Diego Dimitri
Edward Elena Elizabeth Emma Erik Eva Fatima Fernando Filip Francesca Francisco François Frank Frederick Gabriel Giulia Greg Gregory Günther Hans Hassan Helen Helena Henrik Hugo Ingrid Inês Isabel Ivan
Jacqueline Jakub James Jan Jean Jeff Jennifer Jessica Jim Joe Johan Johanna John Jonas Jonathan José Joseph Juan Julia Julian Jürgen Karl Kate Katarzyna Kenji Kenneth Lars Laura Lawrence Leila Lena Linda Lisa Luca Lucas Lucía Luis
Łukasz Maggie Magnus Manuel Marc Margaret Maria Mario Mark Marta Martin Mary Matthew Mehmet Mei Michael Miguel Mike Mohammed Monika Natalia Nicholas Nick Nina Noémie Norbert Olga Oliver Olivia Omar Oskar
Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philip Pierre Pieter Piotr Priya Rachel Rafael Raj Rebecca Renata Ricardo Richard Rita Robert Roberto Ronald Rosa Samuel Sandra Sara Sergio Silvia Simon Simone Sofia Sophie Stefan Steven Susan Sven Søren
Tatiana Theodore Thomas Tiago Tim Timothy Tobias Tom Tony Ursula Viktor Viktoria Virginia Vladimir Walter Wei William Yuki Yusuf Zoë Zofia""".split()
ONSETS = "b br c ch d dr f fr g gr h j k kl kr l m n p pr r s sch sh st str t tr v w y z zh tch".split() + [""]
VOWELS = "a e i o u a e i o ai au ei eo ia io ou y á é í ó ö ü ø å ã ę".split()
CODAS = ["", "", "", "n", "r", "l", "s", "m", "k", "t", "nd", "ng", "rt", "lm", "ck", "x"]
ENDINGS = "son sen ski sky wicz ova ov ev ic vić ez es ini elli etti ard berg mann man stein feld ford ton ley by dahl holm qvist lund strom gaard mark mayer sma stra ides oglu yan shvili chenko escu a i o e".split()
PLACES = "Hill River Bay Port Lake Old New North South Green White Stone Mill King Queen Church Market Castle Bridge Elm Oak Cedar Maple Birch Park Garden Forest Spring Sun Ash Ford Field Haven Brook".split()
LINES = "Foods Systems Industries Energy Insurance Holdings Capital Partners Group Bank Services Technologies Materials Labs Pharma Institute University Hotel Museum Foundation College Airlines Motors Media".split()
LEGAL = "Ltd Inc Corp GmbH AG SA PLC LLC BV AB S.p.A. Co".split()


def syllables(r: random.Random, n: int) -> str:
    return "".join(r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS) for _ in range(n))


def word(r: random.Random, lengths: tuple[int, ...] = (1, 2, 2, 3)) -> str:
    made = syllables(r, r.choice(lengths))
    return (made if len(made) > 1 else made + "an").capitalize()


def given(r: random.Random) -> str:
    name = r.choice(GIVEN) if r.random() < 0.55 else word(r, (1, 2, 2))
    return f"{name}-{r.choice(GIVEN)}" if r.random() < 0.04 else name


def surname(r: random.Random) -> str:
    name = word(r, (1, 2, 2, 3)) if r.random() < 0.35 else (syllables(r, r.choice((1, 2, 2))) + r.choice(ENDINGS)).capitalize()
    x = r.random()
    if x < 0.05:
        return f"{name}-{word(r)}"
    if x < 0.1:
        return r.choice(("de ", "de la ", "van ", "van der ", "von ", "da ", "das ", "di ", "Le ", "O’", "O'", "Mc", "al-", "El ")) + name
    return name


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def filled(r: random.Random, form: str) -> str:
    """``#`` a digit, ``@`` a capital letter."""
    return "".join(digits(r, 1) if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in form)


def person(r: random.Random) -> str:
    g, s = given(r), surname(r)
    i, j = (r.choice("ABCDEFGHIJKLMNOPQRSTUVWYZ") for _ in range(2))
    out = r.choice((f"{g} {s}",) * 5 + (f"{g} {i}. {s}", f"{s}, {g}", f"{s}, {g}", f"{g[0]}. {s}", f"{g[0]}.{j}. {s}", f"{g[0]}. {j}. {s}", f"{g[0]} {j} {s}", f"{s} {g}", f"{s}, {g[0]}.", f"{s}, {g} {i}.", f"{g} {r.choice(GIVEN)} {s}", f"{g} {s} {surname(r)}"))
    return r.choice((out,) * 5 + (out.upper(), out.lower()))


AT = (" [at] ", " (at) ", "(at)", "[at]", " at ", " {at} ", " arroba ", " chiocciola ", " AT ", " @ ")
DOT = (" dot ", " (dot) ", " [dot] ", ".", ".", " punto ", " punkt ", " point ")


def plain(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.translate(str.maketrans({"ø": "o", "ł": "l", "Ł": "L", "’": "", "'": ""})))
    return re.sub(r"[^a-z0-9-]", "", folded.lower()) or "post"


def email(r: random.Random) -> str:
    g, s = plain(given(r)), plain(surname(r))
    local = r.choice((f"{g}.{s}", f"{g}_{s}{digits(r, 2)}", f"{g[0]}{s}", g, f"{s}+jobs", f"office-{digits(r, 2)}", f"{g}{digits(r, 3)}", f"{s}.{g}", f"{g}-{s}", "info", "contact", "hr", f"{g[0]}.{s}"))
    middle = r.choice((plain(word(r)), f"{plain(word(r))}-{r.choice(LINES).lower()}", "example", "example", "gmail", "mail", "company", f"mail.{plain(word(r))}", "hr.example", "post.example"))
    host = f"{middle}.{r.choice('com com com org net de fr es pt it nl se pl ru co.uk io eu com.br example'.split())}"
    if r.random() < 0.6:
        out = f"{local}@{host}"
    else:
        at, dot = r.choice(AT), r.choice(DOT)
        out = (local if r.random() < 0.7 else local.replace(".", dot)) + at + host.replace(".", dot)
    return r.choice((out,) * 5 + (out.upper(),))


def phone(r: random.Random) -> str:
    x, gap = r.random(), r.choice((" ", " ", "-", ".", " "))
    if x < 0.45:  # international: country, area, groups
        body = gap.join(digits(r, r.choice((2, 3, 3, 4))) for _ in range(r.choice((2, 3, 3, 4))))
        return f"{r.choice(('+', '+', '+', '00'))}{r.choice('1 7 20 31 33 34 36 39 41 44 45 46 47 48 49 52 55 61 81 86 91 351 353 420'.split())}{r.choice((' ', ' ', '-', '', ' (0)'))}{body}"
    if x < 0.75:  # North American
        return filled(r, r.choice(("(###) ###-####", "###-###-####", "###.###.####", "1-###-###-#### ext. ##", "##########", "+1###555####", "1 (###) ###-####", "###-555-01## x##", "### ### ####")))
    return filled(r, r.choice(("0### ######", "020 #### ####", "0## #######", "0##-######", "0# ## ## ## ##", "(0##) #### ####", "0#### / ######", "### ### ###", "07### ######", "06-########", "(##) #####-####", "8 (###) ###-##-##")))


IDS = (
    "###-##-####", "###-##-####", "@@######@", "@@ ## ## ## @", "@########", "@### #####", "@#######", "#########", "98#######", "## ### ### ###", "###########", "######-####", "########-####", "###.###.###-##", "########@", "@-#######-@",
    "@@@@@@##@##@###@", "### ### ####", "#### #### ####", "@###-####-####", "############", "###-###-### ##", "@@#######", "#.##.##.###.###-##", "######/####",
)


def id_number(r: random.Random) -> str:
    return filled(r, r.choice(IDS))


def town(r: random.Random) -> str:
    return r.choice((word(r, (2, 3)), f"{r.choice(PLACES)}{r.choice(PLACES).lower()}", f"{r.choice(('Saint-', 'San ', 'Bad ', 'Puerto ', 'Vila ', 'Stary '))}{word(r)}", f"{r.choice(PLACES)}ton"))


def address(r: random.Random) -> str:
    n = f"{r.randint(1, 299)}{r.choice(('', '', '', '', 'b', 'a', ' bis'))}"
    name = r.choice((word(r, (2, 2, 3)), r.choice(PLACES), f"{given(r)}", f"{r.choice(PLACES)} {r.choice(PLACES)}"))
    way = r.choice("Avenue Court Row Road Drive Way Lane Street Terrace Close Crescent Place Square Boulevard".split())
    short = r.choice(("St", "St.", "Rd.", "Ave", "Ave.", "Blvd", "Blvd.", "Dr", "Ln"))
    code, place = r.choice((digits(r, 5), digits(r, 5), digits(r, 4), filled(r, "##-###"), filled(r, "#### @@"))), town(r)
    end = r.choice(("", "", f", {place}", f", {code} {place}"))
    stem = r.choice((word(r, (1, 2)), r.choice(GIVEN)))
    return r.choice((
        f"{n} {name} {way}{end}", f"{n} {name} {way}", f"Flat {r.randint(1, 60)}, {n} {name} {way}{end}", f"{r.randint(100, 9999)} {r.choice(('N. ', 'S. ', 'E. ', 'W. ', ''))}{name} {short}{r.choice(('', f', Apt {r.randint(1, 99)}', f', Suite {r.randint(100, 999)}'))}", f"{n} {name} {way}, {place} {filled(r, '@@# #@@')}",
        f"{stem}{r.choice(('straße', 'strasse', 'str.', 'weg', 'platz', 'gasse', 'allee'))} {n}{end}", f"{r.choice(('Am', 'An der', 'Im', 'Zum', 'Auf dem'))} {word(r)} {n}{end}", f"{stem}er Straße {n}{end}",
        f"{n}{r.choice((' ', ', '))}{r.choice(('rue', 'avenue', 'boulevard', 'place', 'chemin', 'allée'))} {r.choice(('de ', 'des ', 'du ', 'de la ', ''))}{name}{end}", f"{n} rue des {word(r)}s{end}",
        f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'))} {r.choice(('', 'de ', 'del ', 'de la '))}{name}{r.choice((' ', ', '))}{n}{r.choice(('', ', 2º B', ', 3º izq.', end))}", f"{r.choice(('Rua', 'Avenida', 'Travessa', 'Praça'))} {r.choice(('', 'da ', 'do ', 'das '))}{name}, {n}{end}",
        f"{r.choice(('Via', 'Viale', 'Piazza', 'Corso'))} {r.choice(('', 'dei ', 'della ', 'del '))}{name}{r.choice((' ', ', '))}{n}{end}", f"{stem}{r.choice(('straat', 'laan', 'weg', 'gracht', 'plein', 'kade'))} {n}{end}", f"{stem}{r.choice(('gatan', 'vägen', 'gränd', 'vej', 'gade', 'veien'))} {n}{end}",
        f"{r.choice(('ul.', 'al.', 'pl.', 'os.'))} {name} {n}{r.choice(('', f'/{r.randint(1, 50)}', f' m. {r.randint(1, 50)}'))}{end}",
    ))


MAKERS = {"name": person, "email": email, "phone": phone, "id_number": id_number, "address": address}


def make(kind: str, r: random.Random) -> str:
    return MAKERS[kind](r)


FRAMES = {
    "name": ("Great talk by {} today.", "Danke an {} für die Hilfe.", "Merci à {} pour son aide.", "Gracias a {} por todo.", "Obrigado a {} pelo apoio.", "Grazie a {} per il lavoro.", "Met dank aan {} voor de hulp.", "Tack till {} för hjälpen.", "Dziękuję, {}, za pomoc.", "Big thanks to {}, who led this.", "Congratulations to {} on the new role!",
             "Panel: {} and two guests.", "my colleague {} will take over.", "Photo by {}", "As {} told me: ship it.", "— {}", "{}", "({}).", "I met {} at the site last week.", "Happy birthday, {}!", "{} asked the best question.", "With {} and the whole crew.", "I met Dr. {} at the site last week.", "– {}.", "Thank you {}!", "{} wrote to us.",
             "Today {} joins the board.", "We interviewed {} about it.", "according to {}, it works", "Herr {} kommt morgen.", "Mme {} a répondu.", "Sr. {} respondió ayer.", "Meeting with {} and others at noon.", "Contact {} for details."),
    "email": ("You can reach me at {}, any time.", "mail {} ok?", "Contact: {}.", "Contact: <{}>.", "Escríbeme a {}.", "Escreva para {}.", "Scrivimi a {}", "Write to {} for details.", "Schreibt mir: {}", "Mail naar {}.", "→ {}", "CVs please to {}", "Questions? {}", "({}).", "– {}.", "{}", "<{}>", "My address is {} now."),
    "phone": ("Call me on {}.", "Text {} to sign up.", "{} after 5pm.", "Ruft an: {}.", "Appelez le {}.", "Llámame al {}.", "Ligue para {}.", "Chiamami al {}.", "Bel mij op {}.", "Ring mig på {}.", "Tel. {}", "Tel: {}", "phone/WhatsApp: {}!", "Dial {} and ask for the desk.", "My cell is {}", "My mobile: {}", "({}).", "– {}.", "{}", "Call {} or write."),
    "id_number": ("SSN {} was on the form.", "My social security number {} leaked again.", "They printed my passport {} on the badge!", "Steuer-ID {}, please don't share.", "For the refund: personnummer {}.", "NI number: {} was on the form.", "Driver license {} leaked again.", "HR asked for it twice: SSN {}", "(national insurance no. {}).", "My Passport no. {} leaked again.",
                  "personal tax ID {}, please don't share.", "– tax ID {}.", "Meine Steuernummer ist {}.", "Mon numéro de sécurité sociale : {}.", "Mi DNI es {}.", "Meu CPF é {}.", "Il mio codice fiscale: {}", "Mijn BSN is {}.", "Mój PESEL to {}.", "Aadhaar {} on file.", "NHS number {}.", "ID card {} was lost.", "CPF {}", "passport number {}", "NIF {}"),
    "address": ("I live at {}, ring twice.", "Come to {} on Friday.", "Drop by: {}!", "Open house, {}.", "New office: {}", "Send samples to {}", "We moved to {}.", "({}).", "– {}.", "{}", "Ich wohne {}.", "Wir sind jetzt in der {}.", "J’habite au {}.", "Vivo en {}.", "Moro na {}.", "Abito in {}.", "Ik woon op {}.", "Jag bor på {}.", "Mieszkam przy {}.", "Parcels go to {}, please."),
}
DECOYS = (
    "Invoice {4}-{3}-{2} was paid late.", "Order {4}-{2} shipped on 2024-0{1}-1{1}.", "The room code is {2} {4}.", "Tracking {10} was delivered at noon.", "ISBN 978-{1}-{2}-{6}-{1} is on my desk.", "Case {3} of {4} closed today.", "We served {2} {3} {3} requests in 24 hours.",
    "Version {1}.{1}.{2}-rc1 goes live at 10:45.", "Batch {3}-{2} passed, batch {3}-{2} did not.", "See ticket OPS-{5} and build {2}.{1}.{1}.{4}.", "Revenue went from {1},{3},{3} to {1},{3},{3} in 2023-2024.", "Join us in Hall {1}, Room {3}, at 9.30.",
    "We met again at Hotel <g>.", "<g> & Partners advised us on the deal.", "Thanks <g>, see you.", "<s> & <g> Ltd won.", "Grand Avenue Partners joined the panel.", "Main Street cares more about this than any trader.", "Route {2} to growth, part {1} of {2}.",
    "We opened {2} new sites and {1} avenues of research.", "The {2} Hour Drive challenge starts again.", "{1} Roads to better data: a thread.", "Ping @finance_desk at the usual time.", "Follow @boardnotes and @dataguild for updates.", "Ratio {1}:1, margin {2}.5%, beta 0.{2}.",
    "Thanks to the Northern Lights team and Blue Harbour Capital.", "The management of <s> <l> is proud.", "Version QQ-{2} of the form is out.", "https://example.org/a/{6}", "<s> <l> <f> reports today.", "Together with <s> <l>.", "<s> <l>.", "We thank <s> <l> for the data.", "The <s> <l> and <s> <l> <f> merged.", "Welcome, <g>!", "<g> said so.", "#<s> #<l> 2024",
    "The city of <s> grew.", "From <p> <p> to Bad <s>.", "<l> and <l> lead the index.", "Board Meeting and Annual Report {4}.", "1.{2}\t1.{2}\t1.0{1}", "{7} {2} 3.{5} 2^10", "Chief Executive Officer", "Senior Vice President, Human Resources", "University of <s>", "{\"tags\": [\"<s>\", \"<l>\"]}",
)


def decoy(r: random.Random) -> str:
    s = re.sub(r"\{(\d+)\}", lambda m: digits(r, int(m[1])), r.choice(DECOYS))
    for mark, pool in (("<l>", LINES), ("<f>", LEGAL), ("<p>", PLACES)):
        while mark in s:
            s = s.replace(mark, r.choice(pool), 1)
    while "<s>" in s:
        s = s.replace("<s>", word(r, (2, 3)), 1)
    return s.replace("<g>", r.choice(GIVEN))


def compose(texts: list[str], r: random.Random) -> tuple[str, np.ndarray]:
    """A text with labelled spans."""
    base = r.choice(texts)
    if r.random() < 0.06:
        base = base.upper()
    parts: list[tuple[str, np.ndarray]] = [(s, np.zeros(len(s), np.int8)) for s in re.split(r"(?<=[.!?])\s+", base)[: r.choice((1, 2, 4, 8))]]
    if r.random() < 0.2:
        parts = []
    for _ in range(r.choice((0, 1, 1, 2, 3))):
        if r.random() < 0.35:
            s = decoy(r)
            tags = np.zeros(len(s), np.int8)
        else:
            kind = r.choice((*TYPES, "name"))
            frame, value = r.choice(FRAMES[kind]), make(kind, r)
            if parts and r.random() < 0.25:  # amid a sentence
                words = parts.pop(r.randrange(len(parts)))[0].split(" ")
                at = r.randint(0, len(words))
                frame = " ".join([*words[:at], r.choice(("{}", "{}", "({})", "<{}>", "{},")), *words[at:]]) + "."
            a = frame.index("{}")
            s = frame[:a] + value + frame[a + 2 :]
            tags = np.zeros(len(s), np.int8)
            k = TYPES.index(kind)
            tags[a : a + len(value)] = 2 * k + 2
            tags[a] = 2 * k + 1
        parts.insert(r.randint(0, len(parts)), (s, tags))
    glue = r.choice((" ", " ", "\n", "\n\n"))
    text, tags = "", [np.zeros(0, np.int8)]
    for s, t in parts:
        text += s + glue
        tags += [t, np.zeros(len(glue), np.int8)]
    end = len(text) if r.random() < 0.2 else len(text.rstrip())  # most texts end with their last sign
    return text[:end], np.concatenate(tags)[:end]


def garble(text: str, tags: np.ndarray, r: random.Random) -> tuple[str, np.ndarray]:
    """The same read with a wrong code page, labels kept."""
    page = r.choice(("cp1252", "latin-1", "cp1252", "cp437", "mac_roman"))
    out, labels = [], []
    for ch, tag in zip(text, tags, strict=True):
        shown = ch if ch < "\x80" else "".join(bytes([b]).decode(page, "replace") for b in ch.encode("utf-8", "replace"))
        out.append(shown)
        labels += [tag] + [tag + 1 if tag and tag % 2 else tag] * (len(shown) - 1)
    return "".join(out), np.array(labels, np.int8)


def batch(texts: list[str], r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros((GROUP, SPAN), np.int64)
    tags = np.zeros((GROUP, SPAN), np.int64)
    for row in range(GROUP):
        text, t = compose(texts, r)
        while r.random() < 0.2:
            text, t = garble(text, t, r)
        codes = encode(text)
        spots = np.flatnonzero(t)
        if len(spots) and r.random() < 0.75:
            a = int(r.choice(spots)) - r.randint(0, SPAN - 8)
        else:
            a = r.randint(-2, max(0, len(codes) - SPAN + 2))
        a = max(-1, a)
        lead = 1 if a < 0 else 0
        part, labels = codes[max(a, 0) : max(a, 0) + SPAN - lead], t[max(a, 0) : max(a, 0) + SPAN - lead]
        ids[row, lead : lead + len(part)] = part
        tags[row, lead : lead + len(part)] = labels
        if lead == 0 and tags[row, 0] and tags[row, 0] % 2 == 0:
            tags[row, 0] -= 1
    return ids, tags


def start(seed: int = 1) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    u = lambda *s: (g.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1
    return {"embedding": (0.3 * g.standard_normal((N_SIGNS, EMBED))).astype(np.float32), "wx": u(2, EMBED, 4 * HIDDEN), "wh": u(2, HIDDEN, 4 * HIDDEN), "b": b, "out": u(2 * HIDDEN, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "trans": np.zeros((N_TAGS, N_TAGS), np.float32), "first": np.zeros(N_TAGS, np.float32)}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def gradients(w: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood of the CRF and its gradients, by hand."""
    n, time = ids.shape
    h = HIDDEN
    both = np.stack([ids, ids[:, ::-1]])
    table = np.einsum("ve,deg->dvg", w["embedding"], w["wx"]) + w["b"][:, None]
    side = np.arange(2)[:, None]
    s, c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    keep = []
    for t in range(time):
        gates = np.matmul(s, w["wh"]) + table[side, both[:, :, t]]
        sig = 1 / (1 + np.exp(-gates[..., : 3 * h]))
        new = np.tanh(gates[..., 3 * h :])
        before_c, before_s = c, s
        c = sig[..., h : 2 * h] * c + sig[..., :h] * new
        tc = np.tanh(c)
        s = sig[..., 2 * h :] * tc
        keep.append((sig, new, before_c, tc, before_s, s))
    joined = np.stack([np.concatenate([keep[t][5][0], keep[time - 1 - t][5][1]], 1) for t in range(time)])  # time, n, 2h
    scores = joined @ w["out"] + w["bias"]
    # CRF: forward and backward sums give the expected tags and transitions.
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + w["first"]
    for t in range(1, time):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + w["trans"], 1) + scores[t]
    beta = np.zeros_like(scores)
    for t in range(time - 2, -1, -1):
        beta[t] = _lse(w["trans"][None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - z[None, :, None])
    d_first = d_scores[0].sum(0)
    d_trans = np.zeros_like(w["trans"])
    for t in range(1, time):
        d_trans += np.exp(alpha[t - 1][:, :, None] + w["trans"] + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(n)
    gold = w["first"][tags[:, 0]].sum()
    for t in range(time):
        gold += scores[t, rows, tags[:, t]].sum()
        d_scores[t, rows, tags[:, t]] -= 1
        if t:
            gold += w["trans"][tags[:, t - 1], tags[:, t]].sum()
            np.subtract.at(d_trans, (tags[:, t - 1], tags[:, t]), 1)
    np.subtract.at(d_first, tags[:, 0], 1)
    loss = float(z.sum() - gold) / n
    g = {"trans": d_trans, "first": d_first, "out": np.einsum("tnh,tnk->hk", joined, d_scores), "bias": d_scores.sum((0, 1))}
    d_joined = d_scores @ w["out"].T
    d_table = np.zeros_like(table)
    g["wh"] = np.zeros_like(w["wh"])
    d_s, d_c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    for t in range(time - 1, -1, -1):
        sig, new, before_c, tc, before_s, _ = keep[t]
        d_s = d_s + np.stack([d_joined[t][:, :h], d_joined[time - 1 - t][:, h:]])
        i, f, o = sig[..., :h], sig[..., h : 2 * h], sig[..., 2 * h :]
        d_c = d_c + d_s * o * (1 - tc * tc)
        d_gates = np.concatenate([d_c * new * i * (1 - i), d_c * before_c * f * (1 - f), d_s * tc * o * (1 - o), d_c * i * (1 - new * new)], 2)
        g["wh"] += np.matmul(before_s.transpose(0, 2, 1), d_gates)
        for k in range(2):
            np.add.at(d_table[k], both[k, :, t], d_gates[k])
        d_s = np.matmul(d_gates, w["wh"].transpose(0, 2, 1))
        d_c = d_c * f
    g["b"] = d_table.sum(1)
    g["wx"] = np.einsum("ve,dvg->deg", w["embedding"], d_table)
    g["embedding"] = np.einsum("dvg,deg->ve", d_table, w["wx"])
    return loss, {k: v / n for k, v in g.items()}


_TEXTS: list[str] = []


def _turn(job: tuple[dict, dict, dict, int, int, int, float]) -> tuple[dict, dict, dict, float]:
    """Some Adam steps from shared weights; turns of all processes are averaged."""
    w, m, v, step, seed, steps, rate = job
    r = random.Random(seed)
    losses = []
    for k in range(steps):
        loss, g = gradients(w, *batch(_TEXTS, r))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        t = step + k + 1
        for name, x in g.items():
            x = x * scale
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.995 * v[name] + 0.005 * x * x
            w[name] = (w[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.995**t)) + 1e-7)).astype(np.float32)
        losses.append(loss)
    return w, m, v, float(np.mean(losses))


def train(texts: list[str], minutes: float, processes: int = 8, steps: int = 12, weights: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Rounds of parallel steps; ``weights`` continues an earlier training."""
    global _TEXTS
    _TEXTS = texts
    w = weights or start()
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    began, step, turn = time.time(), 0, 0
    with mp.get_context("fork").Pool(processes) as pool:
        while (gone := (time.time() - began) / (60 * minutes)) < 1:
            rate = (3e-3 if weights else 6e-3) * (min(1, (turn + 1) / 10) if gone < 0.5 else 2 * (1 - gone) + 0.02)
            seed = 1000 * turn + (500_000_000 if weights else 0)
            jobs = [(w, m, v, step, seed + p, steps, rate) for p in range(processes)]
            got = pool.map(_turn, jobs)
            w, m, v = ({k: np.mean([g[i][k] for g in got], 0).astype(np.float32) for k in w} for i in range(3))
            step, turn = step + steps, turn + 1
            if turn % 5 == 0:
                print(f"{time.time() - began:.0f} s, step {step}: loss {np.mean([g[3] for g in got]):.3f}", flush=True)
    return w


def mean(paths: list[str]) -> dict[str, np.ndarray]:
    """Mean of weights of one training at several times, which generalises better than the last alone."""
    held = [load_weights(p) for p in paths]
    return {k: np.mean([w[k] for w in held], 0).astype(np.float32) for k in held[0]}


def sample_texts(folder: str) -> list[str]:
    """Sentences' source: texts of a corpus that is not searched, at most ``SAMPLE``."""
    import pyarrow.dataset as ds

    rows = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["text"])
    texts = sorted({t for t in rows.column(0).to_pylist() if t and t.strip()})
    random.Random(3).shuffle(texts)
    return texts[:SAMPLE]


if __name__ == "__main__":
    args = argparse.ArgumentParser()
    args.add_argument("--texts", required=True)
    args.add_argument("--minutes", type=float, default=7)
    args.add_argument("--processes", type=int, default=8)
    args.add_argument("--resume", action="store_true")
    a = args.parse_args()
    weights = train(sample_texts(a.texts), a.minutes, a.processes, weights=load_weights() if a.resume else None)
    np.savez_compressed(WEIGHTS, **{k: x.astype(np.float16) for k, x in weights.items()})
