"""Invented lines with labelled personal data, made by a rule from sentence frames and fillers.

A frame's slots are N (a name), C (a phone number or a spelled-out address), I (an identifier) and
S (a secret), which are labelled, and w, W, d, y, c and h (words, capitalised words, numbers,
years, cities and digests), which are not. The two parts, `train` and `held`, share no frame, name
or number: what is measured on the second was not learned. All of it is made up.
"""

from __future__ import annotations

import random

#: Sentence frames in four languages, by part.
FRAMES = {
    "train": """
Dear {N}, thank you for the letter.
Dear Mr. {N}, the parcel has been sent.
Dear Dr. {N},
Hello {N}, how was the trip?
Please ask Mrs. {N} about the room.
Contact: {N}, second floor
Name: {N}
Patient: {N}
Signed by Dr. {N} on Monday.
My name is {N} and this is my house.
Kind regards, {N}
Yours sincerely, {N}
The author is Prof. {N} of {c}.
Sehr geehrte Frau {N}, vielen Dank.
Sehr geehrter Herr {N}, wir bitten um Antwort.
Mein Name ist {N} und ich komme aus {c}.
Ansprechpartner: Herr {N}
Mit freundlichen Grüßen, {N}
Liebe {N}, bis morgen.
Madame {N} est absente.
Monsieur {N} arrive demain.
Nom: {N}
Je m'appelle {N}, je suis de {c}.
Cordialement, {N}
Cher {N}, merci pour la lettre.
Estimada {N}, gracias por todo.
Nombre: {N}
La señora {N} vive en {c}.
Me llamo {N} y soy de {c}.
Saludos, {N}
Call {C} before noon.
Call me at {C} today.
Phone: {C}
Mobile {C} after six.
tel {C}
Fax: {C}
My phone number is {C} if needed.
Write to {C} for details.
Tel. {C} oder später.
Telefon: {C}
Handy {C} nur abends.
Rufen Sie {C} an.
Téléphone: {C}
Appelez le {C} demain.
Écrivez à {C} pour plus.
Teléfono: {C}
Llame al {C} por la tarde.
Correo: {C}
Reach him under {C} please.
SSN: {I}
Her social security number is {I} as stated.
Passport {I} was lost.
Passport no. {I} expires soon.
IBAN {I} for the rent.
IBAN: {I}
Tax ID {I} is on file.
Reisepass Nr. {I} ist gültig.
Steuernummer: {I}
Passeport {I} perdu hier.
DNI {I} del cliente.
Pasaporte {I} caducado.
token = "{S}"
the token = "{S}" was stolen
password: {S}
api_key = {S}
API_KEY={S}
export SECRET_KEY={S}
secret = "{S}"
client_secret: "{S}",
the key {S} appears here
key {S} was published by mistake
Authorization: Bearer {S}
Passwort: {S}
Kennwort {S} bitte ändern
mot de passe : {S}
contraseña: {S}
The house is large and the garden is small.
In the year {y} there were {d} houses and {d} shops.
Version {d}.{d}.{d} was released on {y}-04-05 in {c}.
See page {d}, line {d}, of the report from {y}.
Die Straße ist lang und der Garten ist klein.
Im Jahr {y} gab es {d} Häuser in {c}.
Der Hund ist ein Freund. Und die Frau sieht den Mann im Haus.
Les maisons sont grandes et le jardin est petit.
En {y}, la ville de {c} avait {d} habitants.
La casa es grande y el jardín es pequeño.
En {y} había {d} casas y {d} tiendas.
The price fell from {d},{d} to {d} in May.
Room {d} and room {d} are free.
THE END OF THE LINE
He said: never again. Then he left.
Chapter {d}. The Long Road. It was late.
The Long Road to the North. A Tale of Two Rivers.
Where the River Bends. On the Road. At the Gate.
Released under the Open Licence. Public Licence, version {d}.
Items: {d}. bread {d}. milk {d}. butter
one | two | three | four {d}
{W}. {W} was here. {W}. {W} {w} the {W}.
{W} {w} {w}. {W} {w}. {W} {w} {w} {w}.
{W} {W} {W} {W} {W} {W} {W} {W} {W} {W}
{w} {W}. {W}. {w} {W}. {W}.
{W}!! {W}!! {w}% {w}*** {w}& {w}$$$
{w} {w} {w} {w} {w}, {w} {w}.
Dear Customer Service, the parcel is late.
Dear Support Team, nothing works.
Dear Sir or Madam, thank you.
Dear all, the office is closed.
Hello everyone, welcome back.
Sehr geehrte Damen und Herren, wir bitten um Antwort.
Liebe Kollegen, bis morgen.
Das ist ein Haus. Herr und Hund. Frau und Kind.
Cher client, merci.
Madame, Monsieur, merci pour la lettre.
Estimado cliente, gracias por todo.
Hola a todos, buenos días.
The call came late. The name of the river is long.
Mail was slow. A phone rang. The key was lost.
The password must have {d} characters.
A token of thanks was given in {y}.
call {d} times and write {d} lines
Contact: Customer Service
Name: unknown
Kind regards, the team
the dot at the end of the line
he wrote at night, they read at noon
commit {h} by the build
sha256 {h} of the file
checksum: {h}
ISBN {d}-{d}-{d} is out of print
www.example.org is down, see http://example.com/{w}/{d}
pages {d}-{d} and {d}-{d}
the score was {d}-{d}, then {d}-{d}
{d} {d} people came at {d} pm to {c}
El número {d} de la calle es azul.
Menge: {d} Stück. Seite: {d}. Nummer {d}.
Le numéro {d} de la rue, page {d}.
{d} {d} {d} {d}
Name: {N}, Address: {W} {d}
Nombre: {N}, Edad: {d}
Nom: {N}, Adresse: {c}
Name: {N}, Stadt: {c}
Phone: {C} (home)
Mobile {C} (evenings only)
the word (in brackets) is (not) here
It is {W}. The {w} is {c}, and the {w} is {W}.
Heute ist {W}. Es ist {W} und das {w} ist {c}.
{w} {w} is. {W} {w} was. {W} by. {W} {w} at.
{w} {w} ist. {W} {w} es. {W} {w} el. {W} {w}
{w} {w} is {w}. {W} {w} {w}
{w} ist {w}, {w} {w}. {W} {w}
{w} {w} est {w}. {W}, {w} is, {w}. {W} {w}
{W}, {W}, {W}, {W}, {W}, {W}, {W}
a ticket for {d},{d} or {d}.{d} in {y}
between {d} and {d}, {d}.{d} {w} {d}
{w} {d} {w} {d}, {w} {y}
at at at at at at at {w} at
{W} At At At At At At {w} dot dot dot
call call call call name name name {w}
IS!! AT!! EL!! DER!! UND!! {W}!!
""",
    "held": """
Dear Ms. {N}, we received the form.
Hello Mr. {N}, see you there.
Please forward this to Prof. {N} today.
Contact {N} at the front desk.
Name: {N}, age {d}
Best wishes, {N}
My name is {N} and I live in {c}.
Sehr geehrte Frau Dr. {N}, anbei die Liste.
Herr {N} kommt am Montag.
Name: {N}, Ort: {c}
Viele Grüße, {N}
Bonjour Madame {N}, voici la liste.
Monsieur {N} habite à {c}.
Estimado señor {N}, aquí está la lista.
Nombre: {N}, ciudad: {c}
Please call {C} tonight.
Phone {C} or come by.
Telephone: {C} (office)
Tel: {C}
Fax {C} until six.
Write me at {C} soon.
Telefon {C} ab neun Uhr.
Téléphone {C} le matin.
Teléfono {C} de noche.
SSN {I} on the form.
The passport number is {I} here.
Passport: {I}
Send it to IBAN {I} now.
Tax ID: {I}
Reisepass {I} verloren.
DNI: {I}
password = {S}
PASSWORD="{S}"
my api_key is {S} so far
secret: {S}
token: "{S}"
the secret key {S} was found
Passwort = {S}
contraseña {S} guardada
The river is wide and the bridge is old.
In {y} the town had {d} mills, {d} inns and {d} wells.
Im Garten steht ein alter Baum. Das Kind sieht den Vogel.
Le pont est vieux et la rivière est large.
El puente es viejo y el río es ancho.
{W} {w} {W}. {w} {w} {W}, {w}. {W} {w}.
{W} {W} {W} {W} {W} {W}
The Old Bridge. Across the River. In the Town.
Dear Sales Department, the order is wrong.
Sehr geehrtes Team, vielen Dank.
Cher service client, rien ne marche.
Estimado equipo, nada funciona.
The key to the door was under the stone.
She forgot the password in {y}.
call it what you like, {d} or {d}
revision {h} was merged
md5 {h} does not match
version {d}.{d} costs {d},{d} now
lines {d}-{d} of page {d}
{d} {d} {d} and {d}
Phone calls cost {d} a minute.
A passport costs {d} since {y}.
""",
}

#: First and last names, cities, by part.
FIRST = {
    "train": "Anna Otto Clara Peter Julia Emil Lena Karl Claire Paul María Juan Robert Yuki Amara Li Fatima Dmitri Jean-Pierre Zoë Élise Bartholomew Ngozi Ana",
    "held": "Rosa Hugo Nadia Tom Ines Viktor Greta Samuel Amélie Luc José Pilar Rajesh Chiamaka Wei Hana Marie-Claude Björn Öykü Al Konstantina Kofi",
}
LAST = {
    "train": "Keller Brandt Hughes Novak Santos Weber Vogel Busch Dupont Girard López Pérez Lane Tanaka Okafor Chen O'Neill Petrov Lefèvre Schwarzenberger MacDonald Ramírez Ng Al-Rashid",
    "held": "Wagner Lind Marlow Horváth Costa Meier Falk Roth Moreau Blanc Gómez Ruiz Subramanian Okonkwo Zhang Sato O'Hara Ivanova Österberg Featherstonehaugh McGregor Núñez Wu Ben-David",
}
CITIES = {"train": "Berlin Lyon Madrid Leeds Graz Porto", "held": "Hamburg Nantes Sevilla York Linz Faro"}


class _Maker:
    def __init__(self, part: str, seed: int) -> None:
        self.part, self.pick = part, random.Random(f"{part}{seed}")

    def _some(self, letters: str, n: int) -> str:
        return "".join(self.pick.choice(letters) for _ in range(n))

    def _shaped(self, shape: str) -> str:
        """9: a digit, A: a capital, a: a small letter."""
        kinds = {"9": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}
        return "".join(self.pick.choice(kinds[c]) if c in kinds else c for c in shape)

    def _word(self) -> str:
        return "".join(self.pick.choice(["b", "d", "gr", "h", "k", "l", "m", "st", "th", "v"]) + self.pick.choice(["a", "e", "i", "o", "u", "an", "er", "ó"]) for _ in range(self.pick.randint(1, 3)))

    def slot(self, kind: str) -> str:
        pick = self.pick
        if kind == "N":
            first, last = (pick.choice(x[self.part].split()) for x in (FIRST, LAST))
            return pick.choice([f"{first} {last}"] * 4 + [last, f"{first} {self._shaped('A')}. {last}"])
        if kind == "C":
            spelled = [f"{self._word()} at {self._word()} dot org", f"{self._word()}[at]{self._word()}.org", f"{self._word()}(at){self._word()}.com", f"{self._word()} [at] {self._word()} [dot] net"]
            return pick.choice([self._shaped(x) for x in ("555-0199", "(999) 555-0199", "099 7946 0999", "030-1239999", "0199/5559999", "999 555 0199", "91 555 09 99", "01 99 00 99 99", "999-555-0199", "0999 1239999")] + spelled[:4])
        if kind == "I":
            return self._shaped(pick.choice(["999-05-9999", "A9999999", "A99A00A99", "AA89370400449999013099", "AA89 3704 0044 9999 0130 99", "99-3456999", "99345678A"]))
        if kind == "S":
            letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
            return pick.choice([self._some("0123456789abcdef", pick.choice([32, 40, 64])), "AKIA" + self._some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk_live_" + self._some(letters, 24), "ghp_" + self._some(letters, 36), self._some(letters, 32) + "=", self._word() + self._shaped("99") + self._word() + "!", self._word().title() + self._shaped("#99a9") + self._word()])
        if kind == "h":
            return self._some("0123456789abcdef", pick.choice([32, 40, 64]))
        if kind == "c":
            return pick.choice(CITIES[self.part].split())
        if kind == "y":
            return str(pick.randint(1700, 2030))
        if kind == "d":
            return str(pick.randint(1, 10 ** pick.randint(1, 3)))
        word = self._word()
        return word.title() if kind == "W" else word


#: What the labelled slots are called.
LABELS = {"N": "name", "C": "contact", "I": "id", "S": "secret"}


def lines(part: str = "train", times: int = 4, seed: int = 1) -> list[list[tuple[str, str | None]]]:
    """Each line as its parts (text, label or None): every frame of `part`, `times` filled in."""
    maker, out = _Maker(part, seed), []
    for frame in FRAMES[part].strip().split("\n"):
        for _ in range(times):
            own: list[tuple[str, str | None]] = []
            for i, piece in enumerate(frame.replace("}", "{").split("{")):
                if piece:
                    own.append((maker.slot(piece), LABELS.get(piece)) if i % 2 else (piece, None))
            out.append(own)
    return out
