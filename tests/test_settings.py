from quercus.plans.settings import Settings, flag


def test_settings():
    found = Settings.from_environment({"QUERCUS_FOUND_PROBABILITY": "0.9", "QUERCUS_FUZZY": "no", "QUERCUS_TEXT_SHORTLIST": "5", "QUERCUS_ODD": "x", "OTHER": "y"})
    assert (found.found_probability, found.fuzzy, found.text_shortlist, found.extra) == (0.9, False, 5, {"odd": "x"})
    assert Settings.from_environment({}) == Settings()
    assert flag(None, True) and flag(" ", True) and not flag("0", True) and flag("on", False)
