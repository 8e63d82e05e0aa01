"""Public links by template, and ids read back from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.addresses import parcel_split
from docketry.functions.text import group_of, url_component, url_plus


def _filled(template: str, *values: Column) -> Column:
    """Template with its ``%s`` replaced; NULL as soon as one value is NULL."""
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def parcel_list_url(parcel_id: Column) -> Column:
    parts = parcel_split(parcel_id)
    return _filled(R.PARCEL_LIST_URL, parts["map"], parts["block"], parts["lot"])


def address_check_url(stnum: Column, name: Column) -> Column:
    return _filled(R.ADDRESS_CHECK_URL, stnum, url_plus(F.lower(name)))


def address_search_url(stnum: Column, name: Column) -> Column:
    return _filled(R.ADDRESS_SEARCH_URL, stnum, url_plus(F.lower(name)))


def property_url(source: Column, ref_id: Column, as_of: datetime | str) -> Column:
    """Property page of a county source; the Lee one carries the tax year."""
    out = F.when(source == "lee_re", _filled(R.LEE_PROPERTY_URL, ref_id, F.lit(str(as_of)[:4])))
    for name, template in R.PROPERTY_URLS.items():
        out = out.when(source == name, _filled(template, ref_id))
    return out


def search_url(text: Column) -> Column:
    return _filled(R.CHATHAM_SEARCH_URL, url_plus(text))


def deed_url(case_number: Column, book: Column, page: Column) -> Column:
    """Direct deed link in three counties, the landing page in three; NULL without book or page."""
    county = F.element_at(F.split(case_number, "-"), -1)
    known = F.contains(case_number, F.lit("-")) & (F.length(book) > 0) & (F.length(page) > 0)
    out = None
    for code, template in R.DEED_URLS.items():
        link = _filled(template, url_plus(book), url_plus(page))
        out = F.when(county == code, link) if out is None else out.when(county == code, link)
    for code, link in R.DEED_LANDING_URLS.items():
        out = out.when(county == code, F.lit(link))
    return F.when(known, out)


def listing_url(address: Column) -> Column:
    text = F.nullif(address, F.lit(""))
    return _filled(R.LISTING_URL, F.replace(url_component(text), F.lit("%20"), F.lit("+")))


def map_url(address: Column) -> Column:
    return _filled(R.MAP_URL, url_component(F.nullif(address, F.lit(""))))


def durham_id(url: Column) -> Column:
    return group_of(url, r"PARCELPK=([^&]*)", flags="")


def harnett_id(url: Column) -> Column:
    return group_of(url, r"prid=([^&]*)", flags="")


def orange_id(url: Column) -> Column:
    return group_of(url, r"/property/(\d{10})(?:/|$|\?)", flags="")


def chatham_id(url: Column) -> Column:
    return group_of(url, r"/parcel/view/(\d+)/", flags="")


def lee_id(text: Column) -> Column:
    return F.coalesce(group_of(text, r"ParID\s*/\s*PIN:\s*(\d+)"), group_of(text, r"PARID:\s*(\d+)"))
