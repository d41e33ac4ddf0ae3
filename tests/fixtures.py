"""Hand-made gazetteer of the test cases (FIXTURES.md section 2)."""

from toponymic.operators.match import Gazetteer

COUNTRIES = [("KE", "Kenya"), ("NA", "Namibia"), ("UG", "Uganda")]
PLACES = [(0, "Nairobi", "KE"), (1, "Mombasa", "KE"), (2, "Windhoek", "NA"), (3, "Kampala", "UG"),
          (4, "Fort Portal", "UG"), (5, "Nairobi", "UG"), (6, "St. John", "KE")]


def places_df(spark, rows=PLACES):
    data = [(r, 1000 + r, n, n, float(r), float(-r), 10 * r, cc) for r, n, cc in rows]
    return spark.createDataFrame(
        data, "row_index long, geonameid long, name string, asciiname string, latitude double, "
              "longitude double, population long, countrycode string")


def countries_df(spark, rows=COUNTRIES):
    return spark.createDataFrame(rows, "iso string, country string")


def gazetteer(spark, regex_names=False, places=PLACES, countries=COUNTRIES):
    return Gazetteer(places_df(spark, places), countries_df(spark, countries), regex_names=regex_names)


def docs_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
