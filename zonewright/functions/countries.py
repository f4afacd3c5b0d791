"""Country codes and names. The table is a parameter; default_rows() builds one from the JVM's ISO 3166 list, NAMES, TERRITORIES and EXTRA."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .checksum import ascii_upper

#: Document codes that ISO 3166 lacks (public ICAO 9303 part 3), behind the ISO rows.
EXTRA = (
    ("UTO", "Utopia (ICAO specimen)"), ("D", "Germany"), ("EUE", "European Union"), ("XKX", "Kosovo"), ("RKS", "Kosovo"), ("GBD", "British Overseas Territories Citizen"), ("GBN", "British National (Overseas)"),
    ("GBO", "British Overseas Citizen"), ("GBP", "British Protected Person"), ("GBS", "British Subject"), ("XXA", "Stateless person (1954 Convention)"), ("XXB", "Refugee (1951 Convention)"),
    ("XXC", "Refugee (other)"), ("XXX", "Unspecified nationality"), ("UNO", "United Nations Organization"), ("UNA", "United Nations specialized agency"),
    ("UNK", "United Nations Interim Administration Mission in Kosovo"), ("XOM", "Sovereign Military Order of Malta"), ("XBA", "African Development Bank"), ("XIM", "African Export-Import Bank"),
    ("XCC", "Caribbean Community (CARICOM)"), ("XCO", "Common Market for Eastern and Southern Africa (COMESA)"), ("XEC", "Economic Community of West African States (ECOWAS)"),
    ("XPO", "International Criminal Police Organization (INTERPOL)"), ("XCE", "Council of Europe"), ("XES", "Organization of Eastern Caribbean States (OECS)"),
    ("XMP", "Parliamentary Assembly of the Mediterranean (PAM)"), ("XDC", "Southern African Development Community"), ("ANT", "Netherlands Antilles"), ("NTZ", "Neutral Zone"), ("IAO", "International Civil Aviation Organization"),
)
#: Names other than the JVM's.
NAMES = {
    "ATG": "Antigua and Barbuda", "BIH": "Bosnia and Herzegovina", "BRN": "Brunei Darussalam", "CIV": "Côte d'Ivoire", "COD": "Congo (Democratic Republic of the)", "COG": "Congo", "CPV": "Cabo Verde",
    "FSM": "Micronesia (Federated States of)", "HKG": "Hong Kong", "KNA": "Saint Kitts and Nevis", "KOR": "Korea (Republic of)", "LAO": "Lao People's Democratic Republic", "LCA": "Saint Lucia", "MAC": "Macao",
    "MMR": "Myanmar", "PRK": "Korea (Democratic People's Republic of)", "PSE": "Palestine", "RUS": "Russian Federation", "STP": "Sao Tome and Principe", "SXM": "Sint Maarten (Dutch part)", "SYR": "Syrian Arab Republic",
    "TTO": "Trinidad and Tobago", "TUR": "Türkiye", "USA": "United States of America", "VAT": "Holy See (Vatican City State)", "VCT": "Saint Vincent and the Grenadines", "VNM": "Viet Nam",
}
#: ISO codes of territories that issue no documents under their own code, so that they count as unknown.
TERRITORIES = (
    "AIA ALA ASM ATA ATF BES BLM BVT CCK COK CXR FLK GGY GLP GUF GUM HMD IMN IOT JEY MAF MNP MSR MTQ MYT NCL NFK NIU PCN PRI PYF REU SGS SHN SJM SPM TCA TKL UMI VGB VIR WLF"
).split()
#: The countries that the catalogue's derived identities come from.
POOL = (
    ("UTO", "Utopia (ICAO specimen)"), ("DEU", "Germany"), ("FRA", "France"), ("ITA", "Italy"), ("ESP", "Spain"), ("POL", "Poland"), ("HRV", "Croatia"), ("SRB", "Serbia"), ("NLD", "Netherlands"), ("SWE", "Sweden"),
    ("CHE", "Switzerland"), ("AUT", "Austria"), ("D", "Germany"), ("XKX", "Kosovo"), ("RKS", "Kosovo"),
)
#: Rows of a table of one's own; lookups are literal maps.
MOST = 1000


def default_rows(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(code, name) of ISO 3166 by the JVM's locale data, but for NAMES and TERRITORIES, by code, then EXTRA."""
    locale = spark._jvm.java.util.Locale
    names = [(x.getISO3Country(), x.getDisplayCountry(locale.ENGLISH)) for x in (locale("", c) for c in locale.getISOCountries())]
    return (*sorted((c, NAMES.get(c, n)) for c, n in names if c not in TERRITORIES), *EXTRA)


def read_rows(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """A table of one's own: CSV with a header and the columns ordinal, code, name."""
    rows = spark.read.option("header", True).csv(path).select(F.col("ordinal").cast("int"), "code", "name").orderBy("ordinal").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"{path} has more than {MOST} rows")
    return tuple((r["code"], r["name"]) for r in rows)


class Countries:
    """Lookups over a table of some hundred rows, as literal maps inside the expression: no join, no shuffle."""

    def __init__(self, rows: tuple[tuple[str, str], ...]):
        self.rows = rows
        by_name: dict[str, str] = {}
        by_code: dict[str, str] = {}
        for code, name in rows:  # the first row of a name wins
            by_name.setdefault(_upper(name), code)
            by_code.setdefault(_upper(code), name)
        self._names, self._any, self._codes = dict(rows), by_code, by_name

    @staticmethod
    def _at(table: dict[str, str], key: Column) -> Column:
        return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]

    def name(self, code: Column) -> Column:
        """Exact and case-sensitive; null if unknown."""
        return self._at(self._names, code)

    def code_for_name(self, name: Column) -> Column:
        """Ignores ASCII case."""
        return self._at(self._codes, ascii_upper(name))

    def equivalent(self, a: Column, b: Column) -> Column:
        """Equal but for ASCII case, or codes of one country."""
        x, y = ascii_upper(a), ascii_upper(b)
        return F.coalesce((x == y) | (self._at(self._any, x) == self._at(self._any, y)), F.lit(False))


def _upper(s: str) -> str:
    return s.translate({c: c - 32 for c in range(97, 123)})
