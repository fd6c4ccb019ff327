"""Given names and titles that mark persons."""

from __future__ import annotations

#: Common given names by script and gender.
GIVEN_BY_CLASS = {
    ("latin", "f"): (
        "Mary Anna Emma Julia Laura Sophie Maria Elena Sarah Alice Clara Helen Martha Nina Olivia Susan Carmen Lucia Ingrid Claire Elizabeth Margaret Jennifer Patricia Linda Barbara Jessica Karen Lisa Nancy Sandra Ashley Emily"
        " Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Catherine Katharina Monika Sabine Ursula Petra Marie Isabelle Nathalie Camille Francesca Giulia Chiara Teresa Beatriz Fatima Aisha Priya"
    ).split(),
    ("latin", "m"): (
        "John Peter Paul James Robert Michael David Thomas Daniel Carlos Pedro Pierre Hans Karl Stefan Andrew George Henry Luis Marc William Richard Joseph Charles Christopher Matthew Anthony Steven Kenneth Kevin Brian Edward"
        " Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Benjamin Samuel Alexander Wolfgang Jürgen Klaus Heinrich Ludwig Friedrich Jacques François Antoine Giovanni Marco Antonio Miguel Javier Mohammed Ahmed Rajesh"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Ιωάννης Νίκος Δημήτρης Κώστας Παναγιώτης".split(),
}
#: Titles that stand before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Señor Señora Sr Sra".split()

#: Particles that stand inside a name.
PARTICLES = "von van de del della di da dos du der den ter la le al el bin ibn".split()

GIVEN_NAMES = {n.lower() for names in GIVEN_BY_CLASS.values() for n in names}
