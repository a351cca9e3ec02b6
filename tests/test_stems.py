from pyspark.sql import functions as F

from velar.functions.stems import stem, stem_of

SAME = {
    "es": ["teléfono teléfonos", "llamar llamando llamado llame llaman", "móvil móviles", "contacto contactar contactos", "vive viven vivir", "dirección direcciones", "domicilio domicilios", "residente residentes"],
    "en": ["call calls calling called", "phone phones", "date dates dated", "sign signed signing signs", "issue issued issuing", "address addresses addressed", "live lives living"],
}
OTHER = {"es": ["calle coche", "edad fecha", "sol sal"], "en": ["age agent", "phone photo", "is as"]}


def test_forms_share_a_stem_and_columns_agree(spark):
    for language, groups in SAME.items():
        for group in groups:
            assert len({stem_of(w, language) for w in group.split()}) == 1, group
        for pair in OTHER[language]:
            assert len({stem_of(w, language) for w in pair.split()}) == 2, pair
        words = " ".join([*groups, *OTHER[language], "LLAMANDO,", "(tel.:", "", "ñandú", "12", "a", "año"]).split(" ")
        df = spark.createDataFrame([(w,) for w in words], "w string")
        assert [r.s for r in df.select(stem(F.col("w"), language).alias("s")).collect()] == [stem_of(w, language) for w in words]
