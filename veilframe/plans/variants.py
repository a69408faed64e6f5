"""One text for every form of a value that a detector knows, and for some that look like one but are none.

Each entry: detector, what stands before the value, the value (None: nothing is to be found), what stands behind it.
"""

from __future__ import annotations

VARIANTS: tuple[tuple[str, str, str | None, str], ...] = (
    ("email", "An <", "first.last+tag@mail.example.co.uk", ">"),
    ("email", "a@b", None, " und @c.de"),
    ("iban", "Konto ", "DE89 3704 0044 0532 0130 00", "."),
    ("iban", "Konto ", "GB29NWBK60161331926819", ","),
    ("bic", "SWIFT-Code: ", "DEUTDEFF", " gilt"),
    ("bic", "kein Wort davor: ", None, "DEUTDEFF"),
    ("social_security", "SSN ", "078-05-1120", ""),
    ("social_security", "AHV ", "7561234567897", ""),
    ("health_card", "Karte ", None, "8071234567890123456789"),
    ("ip", "host ", "2001:db8:85a3:0:0:8a2e:370:7334", " up"),
    ("ip", "host ", None, "300.1.1.1"),
    ("company_id", "UID ", "CHE-123.456.789 MWST", "."),
    ("vin", "VIN ", None, "WVWZZZ1KZAW00012"),
    ("vat", "N. IVA ", "IT12345678901", ""),
    ("vat", "USt-IdNr.: ", "DE123456789", ""),
    ("reference", "claim number: ", "AB-77/3", ". Ende"),
    ("reference", "Numéro de dossier: ", "F2024/17", ""),
    ("reference", "numero di polizza ", "P.99-1", "."),
    ("reference", "Schaden-Nr. ", "S123", ","),
    ("phone", "Tel ", "+41 (0)79 123 45 67", ""),
    ("phone", "Tel ", "0041791234567", ""),
    ("phone", "Tel ", "044 123 45 67", " an"),
    ("phone", "Tel ", "0711/123456", ""),
    ("phone", "Call ", "(555) 123-4567", ""),
    ("phone", "Call ", "555-123-4567", " now"),
    ("phone", "Version ", None, "1.555.123.4567"),
    ("birth_date", "born on ", "March 5, 1980", "."),
    ("birth_date", "née le ", "12 février 1975", ""),
    ("birth_date", "nata il ", "3/4/1990", ""),
    ("birth_date", "date of birth: ", "1980-01-31", ""),
    ("birth_date", "geb. ", "1. Mai 2001", ""),
    ("birth_date", "am ", None, "12.05.2020"),
    ("any_date", "vom ", "31.12.99", ""),
    ("street", "in ", "Alte Landstrasse 12b", ","),
    ("street", "habite ", "Rue de la Gare 5", ""),
    ("street", "abita in ", "Via Roma 17", ""),
    ("street", "lives at ", "221 Baker Street", ", London"),
    ("street", "at ", "10 Old Mill Rd.", ""),
    ("street", "nahe ", None, "Hauptstrasse"),
    ("city", "in ", "79100 Freiburg am Rhein", ""),
    ("city", "à ", "1200 Genève GE", ""),
    ("city", "im ", None, "2024 März"),
    ("plate", "Auto ", "BE-123456", ""),
    ("plate", "Auto ", None, "XX 12345"),
    ("salutation_name", "Dear Mrs. ", "Jane Mary Doe", ", hello"),
    ("salutation_name", "Sehr geehrter Herr Dr. med. ", "Hans Muster", ""),
    ("salutation_name", "Monsieur ", "Dupont", " et"),
    ("salutation_name", "Signora ", "Rossi", "."),
    ("keyword_name", "Customer: ", "John Smith", ", since"),
    ("keyword_name", "Prénom : ", "Amélie", ""),
    ("keyword_name", "Cognome: ", "Bianchi", ""),
    ("keyword_name", "Kontakt: ", None, "Telefon"),
)
