"""Settings, their checks, and the choice between search plans."""
