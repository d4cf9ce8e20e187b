"""jobmill.streaming"""
