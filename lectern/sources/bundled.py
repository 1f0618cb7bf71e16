"""The dictionaries that come with the library: nouns beside numbers, and pronunciation rules."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A pattern on whole words, what is said for it, what markup says, its language (empty: any), and whether it is on."""

    pattern: str
    plain: str
    markup: str = ""
    lang: str = ""
    enabled: bool = True


class Noun(NamedTuple):
    """A noun, its gender (m, f, n), the form of numbers beside it (o ordinal, c cardinal), its singular and its plurals."""

    lang: str
    noun: str
    gender: str
    form: str
    singular: str
    plurals: tuple[str, ...]


#: English rules (pattern, replacement).
ENGLISH = (
    (r"\bMr\.", "Mister"),
    (r"\bMrs\.", "Missus"),
    (r"\bMs\.", "Miss"),
    (r"\bDr\.", "Doctor"),
    (r"\bProf\.", "Professor"),
    (r"\bSt\.", "Saint"),
    (r"\bvs\.", "versus"),
    (r"\betc\.", "etcetera"),
    (r"\be\.g\.", "for example"),
    (r"\bi\.e\.", "that is"),
    (r"\$(\d+)", "$1 dollars"),
    (r"(\d+)%", "$1 percent"),
    ("&", " and "),
    (r"(?i)\bCopyright\b", "Copyright"),
    (r"\(c\)", "Copyright"),
    ("©", "Copyright"),
    (r"(?i)\blinux\b", "Linux"),
    (r"(?i)\bgithub\b", "GitHub"),
    (r"(?i)\bapi\b", "A P I"),
    (r"(?i)\burl\b", "U R L"),
    (r"(?i)\bhtml\b", "H T M L"),
    (r"(?i)\bcss\b", "C S S"),
    (r"(?i)\bsql\b", "S Q L"),
    ("[ \t]+", " "),
)

#: Russian rules (pattern, replacement, replacement with a + before stressed vowels).
RUSSIAN = (
    ("г-н", "господин", "господин"),
    ("г-жа", "госпожа", "госпожа"),
    (r"др\.", "доктор", "доктор"),
    (r"проф\.", "профессор", "профессор"),
    (r"т\.д\.", "так далее", "так далее"),
    (r"т\.п\.", "тому подобное", "тому подобное"),
    (r"т\.е\.", "то есть", "то есть"),
    (r"напр\.", "например", "например"),
    ("МВД", "эм вэ дэ", "эм вэ д+э"),
    ("УВД", "у вэ дэ", "у вэ д+э"),
    ("ФСБ", "эф эс бэ", "эф эс б+э"),
    ("ФСО", "эф эс о", "эф эс +о"),
    ("МИД", "эм и дэ", "эм и д+э"),
    ("МЧС", "эм че эс", "эм че +эс"),
    ("ГИБДД", "гэ и бэ дэ дэ", "гэ и бэ дэ д+э"),
    ("ФНС", "эф эн эс", "эф эн +эс"),
    ("ПФР", "пэ эф эр", "пэ эф +эр"),
    ("ФСС", "эф эс эс", "эф эс +эс"),
    ("РЖД", "эр жэ дэ", "эр жэ д+э"),
    ("ВДНХ", "вэ дэ эн ха", "вэ дэ эн х+а"),
    ("ГД", "гэ дэ", "гэ д+э"),
    ("СФ", "эс эф", "эс +эф"),
    ("РСФСР", "эр эс эф эс эр", "эр эс эф эс +эр"),
    ("СССР", "эс эс эс эр", "эс эс эс +эр"),
    ("КПСС", "ка пэ эс эс", "ка пэ эс +эс"),
    ("КГБ", "ка гэ бэ", "ка гэ б+э"),
    ("НКВД", "эн ка вэ дэ", "эн ка вэ д+э"),
    ("ВЧК", "вэ че ка", "вэ че к+а"),
    ("США", "сэ шэ а", "сэ шэ +а"),
    ("ООН", "о о эн", "о о +эн"),
    ("ЕС", "е эс", "е +эс"),
    ("ЕЭС", "е э эс", "е э +эс"),
    ("СНГ", "эс эн гэ", "эс эн г+э"),
    ("ОБСЕ", "о бэ эс е", "о бэ эс +е"),
    ("ВОЗ", "вэ о зэ", "вэ о з+э"),
    ("МВФ", "эм вэ эф", "эм вэ +эф"),
    ("ВТО", "вэ тэ о", "вэ тэ +о"),
    ("МОК", "эм о ка", "эм о к+а"),
    ("ВВС", "вэ вэ эс", "вэ вэ +эс"),
    ("ВС", "вэ эс", "вэ +эс"),
    ("ВМФ", "вэ эм эф", "вэ эм +эф"),
    ("РВСН", "эр вэ эс эн", "эр вэ эс +эн"),
    ("ВДВ", "вэ дэ вэ", "вэ дэ в+э"),
    ("ГРУ", "гэ эр у", "гэ эр +у"),
    ("СВР", "эс вэ эр", "эс вэ +эр"),
    ("СПбГУ", "эс пэ бэ гэ у", "эс пэ бэ гэ +у"),
    ("МГУ", "эм гэ у", "эм гэ +у"),
    ("РАН", "эр а эн", "эр а +эн"),
    ("НИИ", "эн и и", "эн и +и"),
    ("СМИ", "эс эм и", "эс эм +и"),
    ("ТВ", "тэ вэ", "тэ в+э"),
    ("РТР", "эр тэ эр", "эр тэ +эр"),
    ("ВГТРК", "вэ гэ тэ эр ка", "вэ гэ тэ эр к+а"),
    ("РИА", "эр и а", "эр и +а"),
    ("ООО", "о о о", "о о +о"),
    ("ОАО", "о а о", "о а +о"),
    ("ЗАО", "зэ а о", "зэ а +о"),
    ("ПАО", "пэ а о", "пэ а +о"),
    ("ИП", "и пэ", "и п+э"),
    ("НДС", "эн дэ эс", "эн дэ +эс"),
    ("ВВП", "вэ вэ пэ", "вэ вэ п+э"),
    ("ВНП", "вэ эн пэ", "вэ эн п+э"),
    ("ЦБРФ", "цэ бэ эр эф", "цэ бэ эр +эф"),
    ("ЦБ", "цэ бэ", "цэ б+э"),
    ("ЖД", "жэ дэ", "жэ д+э"),
    ("ЖКХ", "жэ ка ха", "жэ ка х+а"),
    ("ДПС", "дэ пэ эс", "дэ пэ +эс"),
    ("ГАИ", "гэ а и", "гэ а +и"),
    ("СМП", "эс эм пэ", "эс эм п+э"),
    ("ОРВИ", "о эр вэ и", "о эр вэ +и"),
    ("ОРЗ", "о эр зэ", "о эр з+э"),
    ("ИТ", "и тэ", "и т+э"),
    ("ПК", "пэ ка", "пэ к+а"),
    ("ПО", "пэ о", "пэ +о"),
    ("ОС", "о эс", "о +эс"),
    ("СБД", "эс бэ дэ", "эс бэ д+э"),
    ("АСУ", "а эс у", "а эс +у"),
    ("ЭВМ", "э вэ эм", "э вэ +эм"),
    ("ВЦ", "вэ цэ", "вэ ц+э"),
    ("ЛВС", "эл вэ эс", "эл вэ +эс"),
    ("ВПН", "вэ пэ эн", "вэ пэ +эн"),
    ("АйПи", "ай пи", "ай п+и"),
    ("ДНС", "дэ эн эс", "дэ эн +эс"),
    ("ЮСБи", "ю эс би", "ю эс б+и"),
    ("СиДи", "си ди", "си д+и"),
    ("ДиВиДи", "ди ви ди", "ди ви д+и"),
    ("СиПиЮ", "си пи ю", "си пи +ю"),
    ("ГПУ", "гэ пэ у", "гэ пэ +у"),
    ("РКК", "эр ка ка", "эр ка к+а"),
    ("РКА", "эр ка а", "эр ка +а"),
    ("МКС", "эм ка эс", "эм ка +эс"),
    ("ОКБ", "о ка бэ", "о ка б+э"),
    ("КБ", "ка бэ", "ка б+э"),
    ("НПО", "эн пэ о", "эн пэ +о"),
    ("АЭС", "а э эс", "а э +эс"),
    ("ТЭС", "тэ э эс", "тэ э +эс"),
    ("ГЭС", "гэ э эс", "гэ э +эс"),
    ("ТЭЦ", "тэ э цэ", "тэ э ц+э"),
    ("ЛЭП", "эл э пэ", "эл э п+э"),
    ("ТУ", "тэ у", "тэ +у"),
    ("ФК", "эф ка", "эф к+а"),
    ("ХК", "ха ка", "ха к+а"),
    ("БК", "бэ ка", "бэ к+а"),
    ("КХЛ", "ка ха эл", "ка ха +эл"),
    ("РФС", "эр эф эс", "эр эф +эс"),
    ("РФБ", "эр эф бэ", "эр эф б+э"),
    ("УК", "у ка", "у к+а"),
    ("ГК", "гэ ка", "гэ к+а"),
    ("КоАП", "ко а пэ", "ко а п+э"),
    ("ТК", "тэ ка", "тэ к+а"),
    ("ВС РФ", "вэ эс эр эф", "вэ эс эр +эф"),
    ("СК", "эс ка", "эс к+а"),
    ("КС", "ка эс", "ка +эс"),
    ("ВТБ", "вэ тэ бэ", "вэ тэ б+э"),
    ("ИНН", "и эн эн", "и эн +эн"),
    ("ОГРН", "о гэ эр эн", "о гэ эр +эн"),
    ("КПП", "ка пэ пэ", "ка пэ п+э"),
    ("ПТС", "пэ тэ эс", "пэ тэ +эс"),
    ("СТС", "эс тэ эс", "эс тэ +эс"),
    ("РФ", "эр эф", "эр +эф"),
    ("МО", "эм о", "эм +о"),
    ("СПб", "эс пэ бэ", "эс пэ б+э"),
    ("ЛО", "эл о", "эл +о"),
    ("КБР", "ка бэ эр", "ка бэ +эр"),
    ("КЧР", "ка че эр", "ка че +эр"),
    ("ЯНАО", "я эн а о", "я эн а +о"),
    ("ХМАО", "ха эм а о", "ха эм а +о"),
    ("НАО", "эн а о", "эн а +о"),
    ("ЕАО", "е а о", "е а +о"),
    (r"(\d+)\s*км/ч", "$1 километров в час", "$1 килом+етров в ч+ас"),
    (r"(\d+)\s*м/с", "$1 метров в секунду", "$1 м+етров в сек+унду"),
    (r"(\d+)\s*л\.?\s*с\.?", "$1 лошадиных сил", "$1 лош+адиных с+ил"),
    (r"(\d+)\s*кв\.?\s*м", "$1 квадратных метров", "$1 квадр+атных м+етров"),
    (r"(\d+)\s*куб\.?\s*м", "$1 кубических метров", "$1 кубич+еских м+етров"),
    (r"(\d+)\s*г\.?\s*р\.?", "$1 года рождения", "$1 г+ода рожд+ения"),
    (r"(\d+)\s*кг", "$1 килограммов", "$1 килогр+аммов"),
    (r"(\d+)\s*мг", "$1 миллиграммов", "$1 миллигр+аммов"),
    (r"(\d+)\s*г", "$1 граммов", "$1 гр+аммов"),
    (r"(\d+)\s*т", "$1 тонн", "$1 т+онн"),
    (r"(\d+)\s*км", "$1 километров", "$1 килом+етров"),
    (r"(\d+)\s*см", "$1 сантиметров", "$1 сантим+етров"),
    (r"(\d+)\s*мм", "$1 миллиметров", "$1 миллим+етров"),
    (r"(\d+)\s*м", "$1 метров", "$1 м+етров"),
    (r"(\d+)\s*мл", "$1 миллилитров", "$1 миллил+итров"),
    (r"(\d+)\s*л", "$1 литров", "$1 л+итров"),
    (r"(\d+)\s*га", "$1 гектаров", "$1 гект+аров"),
    (r"(\d+)\s*кВт", "$1 киловатт", "$1 килов+атт"),
    (r"(\d+)\s*Вт", "$1 ватт", "$1 в+атт"),
    (r"(\d+)\s*кВ", "$1 киловольт", "$1 килов+ольт"),
    (r"(\d+)\s*В", "$1 вольт", "$1 в+ольт"),
    (r"(\d+)\s*мА", "$1 миллиампер", "$1 миллиамп+ер"),
    (r"(\d+)\s*А", "$1 ампер", "$1 амп+ер"),
    (r"(\d+\.?\d*)\s*ГГц", "$1 гигагерц", "$1 гигаг+ерц"),
    (r"(\d+\.?\d*)\s*МГц", "$1 мегагерц", "$1 мегаг+ерц"),
    (r"(\d+\.?\d*)\s*кГц", "$1 килогерц", "$1 килог+ерц"),
    (r"(\d+\.?\d*)\s*Гц", "$1 герц", "$1 г+ерц"),
    (r"(\d+)\s*мин", "$1 минут", "$1 мин+ут"),
    (r"(\d+)\s*сек", "$1 секунд", "$1 сек+унд"),
    (r"(\d+)\s*ч", "$1 часов", "$1 час+ов"),
    (r"(\d+)%", "$1 процентов", "$1 процентов"),
    ("&", " и ", " и "),
    ("(?i)Copyright", "Копирайт", "Копирайт"),
    (r"\(c\)", "Копирайт", "Копирайт"),
    ("©", "Копирайт", "Копирайт"),
    ("[ \t]+", " ", " "),
)

#: Nouns (language, noun, gender, form of numbers beside it, its plurals).
NOUN_ROWS = (
    ("en", "chapter", "m", "o", ("chapters",)),
    ("en", "page", "m", "o", ("pages",)),
    ("en", "part", "m", "c", ("parts",)),
    ("en", "section", "m", "c", ("sections",)),
    ("en", "volume", "m", "c", ("volumes",)),
    ("en", "book", "m", "c", ("books",)),
    ("en", "episode", "m", "c", ("episodes",)),
    ("en", "act", "m", "c", ("acts",)),
    ("en", "scene", "m", "c", ("scenes",)),
    ("en", "lesson", "m", "c", ("lessons",)),
    ("en", "step", "m", "c", ("steps",)),
    ("en", "level", "m", "c", ("levels",)),
    ("en", "floor", "m", "c", ("floors",)),
    ("en", "grade", "m", "c", ("grades",)),
    ("en", "verse", "m", "c", ("verses",)),
    ("en", "stanza", "m", "c", ("stanzas",)),
    ("en", "paragraph", "m", "c", ("paragraphs",)),
    ("en", "article", "m", "c", ("articles",)),
    ("en", "item", "m", "c", ("items",)),
    ("en", "number", "m", "c", ("numbers",)),
    ("en", "figure", "m", "c", ("figures",)),
    ("en", "table", "m", "c", ("tables",)),
    ("en", "chart", "m", "c", ("charts",)),
    ("en", "appendix", "m", "c", ("appendices", "appendixes")),
    ("en", "exhibit", "m", "c", ("exhibits",)),
    ("en", "round", "m", "c", ("rounds",)),
    ("en", "quarter", "m", "c", ("quarters",)),
    ("en", "half", "m", "c", ("halves",)),
    ("en", "inning", "m", "c", ("innings",)),
    ("en", "period", "m", "c", ("periods",)),
    ("en", "set", "m", "c", ("sets",)),
    ("en", "game", "m", "c", ("games",)),
    ("en", "match", "m", "c", ("matches",)),
    ("en", "race", "m", "c", ("races",)),
    ("en", "lap", "m", "c", ("laps",)),
    ("en", "wave", "m", "c", ("waves",)),
    ("en", "phase", "m", "c", ("phases",)),
    ("en", "stage", "m", "c", ("stages",)),
    ("en", "tier", "m", "c", ("tiers",)),
    ("en", "rank", "m", "c", ("ranks",)),
    ("en", "place", "m", "c", ("places",)),
    ("en", "position", "m", "c", ("positions",)),
    ("en", "dollar", "m", "c", ("dollars",)),
    ("en", "cent", "m", "c", ("cents",)),
    ("en", "pound", "m", "c", ("pounds",)),
    ("en", "euro", "m", "c", ("euros",)),
    ("en", "yen", "m", "c", ("yen",)),
    ("en", "ruble", "m", "c", ("rubles",)),
    ("en", "year", "m", "c", ("years",)),
    ("en", "month", "m", "c", ("months",)),
    ("en", "week", "m", "c", ("weeks",)),
    ("en", "day", "m", "c", ("days",)),
    ("en", "hour", "m", "c", ("hours",)),
    ("en", "minute", "m", "c", ("minutes",)),
    ("en", "second", "m", "c", ("seconds",)),
    ("en", "millisecond", "m", "c", ("milliseconds",)),
    ("en", "percent", "m", "c", ("percents",)),
    ("en", "mile", "m", "c", ("miles",)),
    ("en", "kilometer", "m", "c", ("kilometers",)),
    ("en", "meter", "m", "c", ("meters",)),
    ("en", "centimeter", "m", "c", ("centimeters",)),
    ("en", "millimeter", "m", "c", ("millimeters",)),
    ("en", "foot", "m", "c", ("feet",)),
    ("en", "inch", "m", "c", ("inches",)),
    ("en", "yard", "m", "c", ("yards",)),
    ("en", "liter", "m", "c", ("liters",)),
    ("en", "gallon", "m", "c", ("gallons",)),
    ("en", "ounce", "m", "c", ("ounces",)),
    ("en", "gram", "m", "c", ("grams",)),
    ("en", "kilogram", "m", "c", ("kilograms",)),
    ("en", "ton", "m", "c", ("tons",)),
    ("en", "calorie", "m", "c", ("calories",)),
    ("en", "degree", "m", "c", ("degrees",)),
    ("en", "watt", "m", "c", ("watts",)),
    ("en", "volt", "m", "c", ("volts",)),
    ("en", "ampere", "m", "c", ("amperes",)),
    ("en", "byte", "m", "c", ("bytes",)),
    ("en", "kilobyte", "m", "c", ("kilobytes",)),
    ("en", "megabyte", "m", "c", ("megabytes",)),
    ("en", "gigabyte", "m", "c", ("gigabytes",)),
    ("en", "terabyte", "m", "c", ("terabytes",)),
    ("en", "pixel", "m", "c", ("pixels",)),
    ("en", "person", "m", "c", ("people", "persons")),
    ("en", "man", "m", "c", ("men",)),
    ("en", "woman", "f", "c", ("women",)),
    ("en", "child", "m", "c", ("children",)),
    ("en", "kid", "m", "c", ("kids",)),
    ("en", "soldier", "m", "c", ("soldiers",)),
    ("en", "player", "m", "c", ("players",)),
    ("en", "point", "m", "c", ("points",)),
    ("en", "goal", "m", "c", ("goals",)),
    ("en", "score", "m", "c", ("scores",)),
    ("en", "vote", "m", "c", ("votes",)),
    ("en", "copy", "m", "c", ("copies",)),
    ("en", "piece", "m", "c", ("pieces",)),
    ("en", "unit", "m", "c", ("units",)),
    ("en", "time", "m", "c", ("times",)),
    ("en", "attempt", "m", "c", ("attempts",)),
    ("en", "try", "m", "c", ("tries",)),
    ("en", "shot", "m", "c", ("shots",)),
    ("en", "hit", "m", "c", ("hits",)),
    ("en", "miss", "m", "c", ("misses",)),
    ("en", "win", "m", "c", ("wins",)),
    ("en", "loss", "m", "c", ("losses",)),
    ("en", "draw", "m", "c", ("draws",)),
    ("ru", "глава", "f", "o", ("главы", "глав")),
    ("ru", "страница", "f", "o", ("страницы", "страниц")),
    ("ru", "часть", "f", "o", ("части", "частей")),
    ("ru", "книга", "f", "o", ("книги", "книг")),
    ("ru", "серия", "f", "o", ("серии", "серий")),
    ("ru", "сцена", "f", "o", ("сцены", "сцен")),
    ("ru", "строфа", "f", "o", ("строфы", "строф")),
    ("ru", "строка", "f", "o", ("строки", "строк")),
    ("ru", "статья", "f", "o", ("статьи", "статей")),
    ("ru", "таблица", "f", "o", ("таблицы", "таблиц")),
    ("ru", "картинка", "f", "o", ("картинки", "картинок")),
    ("ru", "волна", "f", "o", ("волны", "волн")),
    ("ru", "фаза", "f", "o", ("фазы", "фаз")),
    ("ru", "стадия", "f", "o", ("стадии", "стадий")),
    ("ru", "позиция", "f", "o", ("позиции", "позиций")),
    ("ru", "том", "m", "o", ("тома", "томов")),
    ("ru", "раздел", "m", "o", ("раздела", "разделов")),
    ("ru", "акт", "m", "o", ("акта", "актов")),
    ("ru", "эпизод", "m", "o", ("эпизода", "эпизодов")),
    ("ru", "урок", "m", "o", ("урока", "уроков")),
    ("ru", "этаж", "m", "o", ("этажа", "этажей")),
    ("ru", "класс", "m", "o", ("класса", "классов")),
    ("ru", "уровень", "m", "o", ("уровня", "уровней")),
    ("ru", "шаг", "m", "o", ("шага", "шагов")),
    ("ru", "параграф", "m", "o", ("параграфа", "параграфов")),
    ("ru", "пункт", "m", "o", ("пункта", "пунктов")),
    ("ru", "номер", "m", "o", ("номера", "номеров")),
    ("ru", "рисунок", "m", "o", ("рисунка", "рисунков")),
    ("ru", "график", "m", "o", ("графика", "графиков")),
    ("ru", "раунд", "m", "o", ("раунда", "раундов")),
    ("ru", "период", "m", "o", ("периода", "периодов")),
    ("ru", "тайм", "m", "o", ("тайма", "таймов")),
    ("ru", "сет", "m", "o", ("сета", "сетов")),
    ("ru", "матч", "m", "o", ("матча", "матчей")),
    ("ru", "забег", "m", "o", ("забега", "забегов")),
    ("ru", "круг", "m", "o", ("круга", "кругов")),
    ("ru", "этап", "m", "o", ("этапа", "этапов")),
    ("ru", "ранг", "m", "o", ("ранга", "рангов")),
    ("ru", "год", "m", "o", ("года", "лет")),
    ("ru", "года", "m", "o", ("года",)),
    ("ru", "году", "m", "o", ("году",)),
    ("ru", "место", "n", "o", ("места", "мест")),
    ("ru", "действие", "n", "o", ("действия", "действий")),
    ("ru", "приложение", "n", "o", ("приложения", "приложений")),
    ("ru", "января", "n", "o", ("января",)),
    ("ru", "февраля", "n", "o", ("февраля",)),
    ("ru", "марта", "n", "o", ("марта",)),
    ("ru", "апреля", "n", "o", ("апреля",)),
    ("ru", "мая", "n", "o", ("мая",)),
    ("ru", "июня", "n", "o", ("июня",)),
    ("ru", "июля", "n", "o", ("июля",)),
    ("ru", "августа", "n", "o", ("августа",)),
    ("ru", "сентября", "n", "o", ("сентября",)),
    ("ru", "октября", "n", "o", ("октября",)),
    ("ru", "ноября", "n", "o", ("ноября",)),
    ("ru", "декабря", "n", "o", ("декабря",)),
    ("ru", "рубль", "m", "c", ("рубля", "рублей")),
    ("ru", "доллар", "m", "c", ("доллара", "долларов")),
    ("ru", "месяц", "m", "c", ("месяца", "месяцев")),
    ("ru", "день", "m", "c", ("дня", "дней")),
    ("ru", "час", "m", "c", ("часа", "часов")),
    ("ru", "человек", "m", "c", ("человека", "человек")),
    ("ru", "ребёнок", "m", "c", ("ребёнка", "детей")),
    ("ru", "ребёнка", "m", "c", ("ребёнка", "детей")),
    ("ru", "ребенок", "m", "c", ("ребенка", "детей")),
    ("ru", "ребенка", "m", "c", ("ребенка", "детей")),
    ("ru", "детей", "m", "c", ("детей",)),
    ("ru", "стол", "m", "c", ("стола", "столов")),
    ("ru", "стола", "m", "c", ("стола", "столов")),
    ("ru", "дом", "m", "c", ("дома", "домов")),
    ("ru", "дома", "m", "c", ("дома", "домов")),
    ("ru", "город", "m", "c", ("города", "городов")),
    ("ru", "города", "m", "c", ("города", "городов")),
    ("ru", "рубля", "m", "c", ("рубля", "рублей")),
    ("ru", "раз", "m", "c", ("раза", "раз")),
    ("ru", "процент", "m", "c", ("процента", "процентов")),
    ("ru", "километр", "m", "c", ("километра", "километров")),
    ("ru", "метр", "m", "c", ("метра", "метров")),
    ("ru", "литр", "m", "c", ("литра", "литров")),
    ("ru", "грамм", "m", "c", ("грамма", "граммов")),
    ("ru", "килограмм", "m", "c", ("килограмма", "килограммов")),
    ("ru", "копейка", "f", "c", ("копейки", "копеек")),
    ("ru", "минута", "f", "c", ("минуты", "минут")),
    ("ru", "секунда", "f", "c", ("секунды", "секунд")),
    ("ru", "неделя", "f", "c", ("недели", "недель")),
    ("ru", "штука", "f", "c", ("штуки", "штук")),
    ("ru", "евро", "n", "c", ("евро",)),
)

ENGLISH_RULES = tuple(Rule(pattern, plain, plain, "en") for pattern, plain in ENGLISH)
RUSSIAN_RULES = tuple(Rule(pattern, plain, markup, "ru") for pattern, plain, markup in RUSSIAN)
RULES = ENGLISH_RULES + RUSSIAN_RULES
NOUNS = tuple(Noun(lang, noun, gender, form, noun, plurals) for lang, noun, gender, form, plurals in NOUN_ROWS)
