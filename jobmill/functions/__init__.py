"""jobmill.functions"""
