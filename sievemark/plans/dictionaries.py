"""Word lists that detection of names and places rests on.

The lists here are short and of our own making: enough to work with, and meant to be replaced by a
folder of lists (a word or phrase a line, the file's name is the list's) where recall matters. They
are driver-side data of checked size and go to the workers in the function that uses them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Bytes of all lists together, at most; more is a corpus, not a dictionary.
MOST_CHARS = 16 << 20

MEN = (
    "александр алексей анатолий андрей антон аркадий арсений артём богдан борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав геннадий георгий "
    "герман глеб григорий даниил денис дмитрий евгений егор иван игорь илья кирилл константин лев леонид максим марк матвей михаил никита николай олег павел пётр роман руслан "
    "семён сергей станислав степан тарас тимур тимофей фёдор эдуард юрий яков ярослав афанасий осип"
)
WOMEN = (
    "александра алина алла анастасия ангелина анна валентина валерия варвара вера вероника виктория галина дарья диана евгения екатерина елена елизавета жанна зинаида зоя инна "
    "ирина карина кира кристина ксения лариса лидия лилия любовь людмила маргарита марина мария надежда наталья нина оксана ольга полина раиса светлана софия тамара татьяна "
    "ульяна юлия яна"
)
SURNAMES = (
    "иванов петров сидоров смирнов кузнецов попов васильев соколов михайлов новиков фёдоров морозов волков алексеев лебедев семёнов егоров павлов козлов степанов николаев орлов "
    "андреев макаров никитин захаров зайцев соловьёв борисов яковлев григорьев романов воробьёв сергеев кузьмин фролов александров дмитриев королёв гусев киселёв ильин максимов "
    "поляков сорокин виноградов ковалёв белов медведев антонов тарасов жуков баранов филиппов комаров давыдов беляев герасимов богданов осипов сидоренко шевченко коваленко "
    "бондаренко ткаченко кравченко мельник шмидт вебер гусак достоевский толстой пушкин чехов тургенев лермонтов черных седых петросян саркисян мкртчян беридзе лукин блинов ефимов"
)
CITIES = (
    "абакан архангельск астрахань барнаул белгород биробиджан благовещенск братск брянск владивосток владикавказ владимир волгоград вологда воронеж выборг гатчина грозный "
    "дзержинск екатеринбург иваново ижевск иркутск йошкар-ола казань калининград калуга кемерово киров коломна кострома краснодар красноярск курган курск липецк магадан магнитогорск "
    "майкоп махачкала мелеуз москва мурманск мытищи нальчик находка новгород новокузнецк новороссийск новосибирск ногинск норильск обнинск омск орёл оренбург пенза пермь петрозаводск "
    "подольск псков пушкин пятигорск ростов рязань самара санкт-петербург саранск саратов севастополь серпухов симферополь смоленск сочи ставрополь сургут сызрань сыктывкар таганрог "
    "тамбов тверь тольятти томск тула тюмень уфа хабаровск химки чебоксары челябинск череповец чита элиста якутск ярославль ростов-на-дону"
)
PHRASES = {
    "cities": ("нижний новгород", "великий новгород", "нижний тагил", "набережные челны", "старый оскол"),
    "countries": ("российская федерация", "республика беларусь", "республика казахстан", "республика молдова", "республика узбекистан", "республика армения"),
}
COUNTRIES = (
    "россия беларусь украина казахстан узбекистан таджикистан туркменистан киргизия армения азербайджан грузия молдова латвия литва эстония польша германия франция италия испания "
    "португалия китай индия турция израиль сербия болгария румыния венгрия чехия словакия финляндия швеция норвегия дания греция кипр сша канада мексика бразилия аргентина япония вьетнам рф"
)
STREETS = (
    "ленина садовая школьная лесная центральная молодёжная новая советская зелёная набережная мира победы гагарина пушкина лермонтова чехова баумана тверская невская московская "
    "заречная солнечная речная луговая вишнёвая берёзовая северная южная восточная западная"
)


def patronymics(men) -> frozenset[str]:
    """Sons and daughters of the men, by rule."""
    from ..functions.morphology import patronymic

    return frozenset(patronymic(m, g) for m in men for g in ("male", "female"))


def folded(word: str) -> str:
    """As words are looked up: lower case; ё counts as е too."""
    return word.strip().lower()


@dataclass(frozen=True)
class Dictionaries:
    """Named sets of lower-case words. A word with ё is there without it as well."""

    lists: dict[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self):
        if sum(len(w) for words in self.lists.values() for w in words) > MOST_CHARS:
            raise ValueError("the dictionaries are too large to go with every task")

    def list(self, name: str) -> frozenset[str]:
        return self.lists.get(name, frozenset())

    @staticmethod
    def of(lists: dict[str, set[str]]) -> Dictionaries:
        both = {name: {folded(w) for w in words if folded(w)} for name, words in lists.items()}
        return Dictionaries({name: frozenset(words | {w.replace("ё", "е") for w in words}) for name, words in both.items()})

    @staticmethod
    def built_in() -> Dictionaries:
        men, women = MEN.split(), WOMEN.split()
        feminine = {w + "а" for w in SURNAMES.split() if w.endswith(("ов", "ев", "ёв", "ин", "ын"))}
        return Dictionaries.of({
            "first_names": {*men, *women}, "surnames": {*SURNAMES.split(), *feminine}, "patronymics": set(patronymics(men)),
            "cities": {*CITIES.split(), *PHRASES["cities"]}, "countries": {*COUNTRIES.split(), *PHRASES["countries"]}, "streets": set(STREETS.split()),
        })

    @staticmethod
    def from_folder(spark: SparkSession, folder: str) -> Dictionaries:
        """All lists of a folder; those that are missing are the built-in ones."""
        from ..sources.tables import read_dictionaries

        out: dict[str, set[str]] = {}
        for row in read_dictionaries(spark, folder).toLocalIterator():
            out.setdefault(row["list"], set()).add(row["word"])
        return Dictionaries({**Dictionaries.built_in().lists, **Dictionaries.of(out).lists})
