"""jobmill.sources"""
