"""quillon: structural and graph analytics as DataFrame plans."""
