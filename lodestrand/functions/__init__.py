"""See the repository README for what lives here."""
