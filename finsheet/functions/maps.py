"""Small reference tables. They are fixed values and stay literal columns: none grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rating ladder, best first, as (S&P, Moody's).
LADDER = (
    ("AAA", "Aaa"), ("AA+", "Aa1"), ("AA", "Aa2"), ("AA-", "Aa3"), ("A+", "A1"), ("A", "A2"), ("A-", "A3"), ("BBB+", "Baa1"),
    ("BBB", "Baa2"), ("BBB-", "Baa3"), ("BB+", "Ba1"), ("BB", "Ba2"), ("BB-", "Ba3"), ("B+", "B1"), ("B", "B2"), ("B-", "B3"),
    ("CCC+", "Caa1"), ("CCC", "Caa2"), ("CCC-", "Caa3"), ("CC", "Ca"), ("C", "C"), ("D", "D"),
)
#: The rungs a rating is snapped to, as (label, S&P notch).
RUNGS = (
    ("A1/A+", "A+"), ("A2/A", "A"), ("A3/A-", "A-"), ("Baa2/BBB", "BBB"), ("Ba1/BB+", "BB+"), ("Ba2/BB", "BB"), ("B1/B+", "B+"),
    ("B2/B", "B"), ("B3/B-", "B-"), ("Caa/CCC", "CCC"), ("Ca2/CC", "CC"), ("C2/C", "C"), ("D2/D", "D"),
)
#: Exchange prefixes of tickers by country; prefixes that two countries use (TSE, OSE) are left out.
PREFIXES = {
    "United States": ("NYSE", "NASDAQ", "NAS", "AMEX", "ARCA", "BATS"), "United Kingdom": ("LSE", "LON"), "Canada": ("TSX", "TSXV", "CVE"), "Japan": ("TYO", "JPX"), "South Korea": ("KRX", "KOSDAQ", "KOSE"),
    "China": ("SHSE", "SZSE", "SHA", "SHE"), "Hong Kong": ("HKSE", "HKG", "SEHK", "HKEX"), "Taiwan": ("TPE", "TWSE", "ROCO"), "India": ("NSE", "BSE", "BOM"), "Indonesia": ("IDX", "JKT"), "Israel": ("TASE", "TLV"),
    "Malaysia": ("KLSE", "MYX"), "Thailand": ("SET", "BKK"), "Brazil": ("BOVESPA", "BVMF", "SAO"), "Germany": ("XETRA", "ETR", "FRA", "XTER"), "Singapore": ("SGX",), "Mexico": ("BMV", "MEX"), "Australia": ("ASX",),
    "Denmark": ("CPH", "OMXC"), "France": ("EPA", "PAR"), "Netherlands": ("AMS",), "Italy": ("BIT", "MIL"), "Spain": ("BME", "MCE", "MAD"), "Sweden": ("STO",), "Finland": ("HEL",), "Norway": ("OSL",), "Belgium": ("EBR", "BRU"),
    "Austria": ("VIE", "WBAG"), "Portugal": ("LIS", "ELI"), "Poland": ("WSE", "WAR"), "Greece": ("ATH",), "Ireland": ("ISE",),
}
EXCHANGES = {prefix: country for country, prefixes in PREFIXES.items() for prefix in prefixes}
#: Plan type and nil cost of the standard award members; their names follow from the members (``text.member_label``).
AWARDS = {
    "EmployeeStockOptionMember": ("ESOP", False), "StockOptionMember": ("ESOP", False), "RestrictedStockUnitsRSUMember": ("RSU", True), "RestrictedStockUnitsMember": ("RSU", True),
    "RestrictedStockMember": ("RSP", True), "PerformanceSharesMember": ("PSU", True), "PerformanceShareUnitsMember": ("PSU", True), "EmployeeStockMember": ("ESPP", False),
    "StockAppreciationRightsSARSMember": ("SAR", False), "WarrantMember": ("WARRANT", False), "PhantomShareUnitsPSUsMember": ("OTHER", True),
}
#: How a currency is written to its ISO code.
CURRENCIES = {
    "$": "USD", "US$": "USD", "USD": "USD", "DOLLARS": "USD", "€": "EUR", "EUR": "EUR", "EURO": "EUR", "EUROS": "EUR", "£": "GBP", "GBP": "GBP",
    "PENCE": "GBP", "¥": "JPY", "JPY": "JPY", "YEN": "JPY", "RMB": "CNY", "CNY": "CNY", "HK$": "HKD", "HKD": "HKD", "₹": "INR", "INR": "INR",
    "R$": "BRL", "BRL": "BRL", "DKK": "DKK", "KR": "DKK", "CHF": "CHF", "C$": "CAD", "CAD": "CAD", "A$": "AUD", "AUD": "AUD", "NT$": "TWD", "TWD": "TWD",
    "S$": "SGD", "SGD": "SGD", "₩": "KRW", "KRW": "KRW", "WON": "KRW", "MXN": "MXN", "PESOS": "MXN", "R": "ZAR", "ZAR": "ZAR", "RAND": "ZAR", "NZ$": "NZD", "NZD": "NZD",
}


def mapped(column, table: dict, otherwise: Column | None = None) -> Column:
    """Look a column up in a small literal map."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, column if isinstance(column, Column) else F.col(column))
    return found if otherwise is None else F.coalesce(found, otherwise)


def rank_of_rating(token: Column) -> Column:
    ranks = {}
    for i, (sp, moody) in enumerate(LADDER):
        ranks[sp.upper()] = ranks[moody.upper()] = i + 1
    return mapped(F.upper(token), ranks)


def family_of_rating(notch: Column) -> Column:
    return F.regexp_replace(notch, "[+-]$", "")


def agency_of_rating(token: Column) -> Column:
    """Case-sensitive: S&P notches are upper case, Moody's are mixed."""
    sp, moody = token.isin(*[s for s, _ in LADDER]), token.isin(*[m for _, m in LADDER])
    return F.when(sp & moody, "S&P/Moody's").when(sp, "S&P").when(moody, "Moody's")


def snap_rating(token: Column) -> Column:
    """Label of the nearest rung; ties prefer the same letter family, then the better rung. Unknown tokens are NULL."""
    rank = rank_of_rating(token)
    notch = F.try_element_at(F.array(*[F.lit(s) for s, _ in LADDER]), rank)
    number = {s: i + 1 for i, (s, _) in enumerate(LADDER)}
    rungs = [F.struct(F.abs(rank - number[s]).alias("d"), F.when(family_of_rating(notch) == s.rstrip("+-"), 0).otherwise(1).alias("f"), F.lit(number[s]).alias("r"), F.lit(label).alias("label")) for label, s in RUNGS]
    return F.when(rank.isNotNull(), F.array_min(F.array(*rungs))["label"])


def country_of_ticker(ticker: Column) -> tuple[Column, Column]:
    """(ticker without its exchange prefix, country of the prefix or NULL)."""
    prefix = F.upper(F.regexp_extract(ticker, "^([A-Za-z]+):", 1))
    return F.regexp_replace(ticker, "^[A-Za-z]+:", ""), mapped(prefix, EXCHANGES)


def rungs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(label, s) for label, s in RUNGS], "label string, notch string")


#: Industry wordings (normal form) and the name of the industry they stand for.
INDUSTRY_WORDS = {
    "advertising agencies": "Advertising", "aerospace & defense": "Aerospace/Defense", "airlines": "Air Transport", "apparel manufacturing": "Apparel",
    "auto manufacturers": "Auto & Truck", "auto parts": "Auto Parts", "banks - diversified": "Bank (Money Center)", "banks - regional": "Banks (Regional)",
    "beverages - brewers": "Beverage (Alcoholic)", "beverages - non - alcoholic": "Beverage (Soft)", "broadcasting": "Broadcasting", "building materials": "Building Materials",
    "chemicals": "Chemical (Basic)", "specialty chemicals": "Chemical (Specialty)", "thermal coal": "Coal & Related Energy", "coking coal": "Coal & Related Energy",
    "computer hardware": "Computers/Peripherals", "conglomerates": "Diversified", "biotechnology": "Drugs (Biotechnology)", "drug manufacturers - general": "Drugs (Pharmaceutical)",
    "education & training services": "Education", "consumer electronics": "Electronics (Consumer & Office)", "steel": "Steel", "tobacco": "Tobacco", "trucking": "Trucking",
}
#: All names that an industry can be given, a published list.
INDUSTRIES = [
    "Advertising", "Aerospace/Defense", "Air Transport", "Apparel", "Auto & Truck", "Auto Parts", "Bank (Money Center)", "Banks (Regional)",
    "Beverage (Alcoholic)", "Beverage (Soft)", "Broadcasting", "Brokerage & Investment Banking", "Building Materials", "Business & Consumer Services",
    "Cable TV", "Chemical (Basic)", "Chemical (Diversified)", "Chemical (Specialty)", "Coal & Related Energy", "Computer Services",
    "Computers/Peripherals", "Construction Supplies", "Diversified", "Drugs (Biotechnology)", "Drugs (Pharmaceutical)", "Education",
    "Electrical Equipment", "Electronics (Consumer & Office)", "Electronics (General)", "Engineering/Construction", "Entertainment",
    "Environmental & Waste Services", "Farming/Agriculture", "Financial Svcs. (Non-bank & Insurance)", "Food Processing", "Food Wholesalers",
    "Furn/Home Furnishings", "Green & Renewable Energy", "Healthcare Products", "Healthcare Support Services", "Heathcare Information and Technology",
    "Homebuilding", "Hospitals/Healthcare Facilities", "Hotel/Gaming", "Household Products", "Information Services", "Insurance (General)",
    "Insurance (Life)", "Insurance (Prop/Cas.)", "Investments & Asset Management", "Machinery", "Metals & Mining", "Office Equipment & Services",
    "Oil/Gas (Integrated)", "Oil/Gas (Production and Exploration)", "Oil/Gas Distribution", "Oilfield Svcs/Equip.", "Packaging & Container",
    "Paper/Forest Products", "Power", "Precious Metals", "Publishing & Newspapers", "R.E.I.T.", "Real Estate (Development)",
    "Real Estate (General/Diversified)", "Real Estate (Operations & Services)", "Recreation", "Reinsurance", "Restaurant/Dining",
    "Retail (Automotive)", "Retail (Building Supply)", "Retail (Distributors)", "Retail (General)", "Retail (Grocery and Food)", "Retail (Online)",
    "Retail (Special Lines)", "Rubber& Tires", "Semiconductor", "Semiconductor Equip", "Shipbuilding & Marine", "Shoe", "Software (Entertainment)",
    "Software (Internet)", "Software (System & Application)", "Steel", "Telecom (Wireless)", "Telecom. Equipment", "Telecom. Services", "Tobacco",
    "Transportation", "Transportation (Railroads)", "Trucking", "Utility (General)", "Utility (Water)",
]
